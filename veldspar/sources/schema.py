"""Schemas of session streams, and readers for them."""

from __future__ import annotations

STREAMS: dict[str, str] = {
    "location": "t DOUBLE, wall DOUBLE, lat DOUBLE, lon DOUBLE, alt DOUBLE, altEllipsoidal DOUBLE, hAcc DOUBLE, vAcc DOUBLE, speed DOUBLE, speedAcc DOUBLE, course DOUBLE, courseAcc DOUBLE",
    "heading": "t DOUBLE, trueHeading DOUBLE, magneticHeading DOUBLE, accuracy DOUBLE",
    "motion": "t DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE, rx DOUBLE, ry DOUBLE, rz DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, mx DOUBLE, my DOUBLE, mz DOUBLE, magAcc INT",
    "pose": "t DOUBLE, frame BIGINT, tx DOUBLE, ty DOUBLE, tz DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, tracking STRING, exposure DOUBLE, gravX DOUBLE, gravY DOUBLE, gravZ DOUBLE",
    "planes": "t DOUBLE, id STRING, event STRING, alignment STRING, classification STRING, tx DOUBLE, ty DOUBLE, tz DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE, width DOUBLE, height DOUBLE, rotationOnYAxis DOUBLE",
    "frames": "t DOUBLE, frame BIGINT, file STRING, width INT, height INT, bytes BIGINT",
    "depth": "t DOUBLE, frame BIGINT, offset BIGINT, length BIGINT, width INT, height INT, format STRING, confidenceOffset BIGINT, confidenceLength BIGINT, cond DOUBLE, weakAxis ARRAY<DOUBLE>, conditioningSamples INT",
    "events": "t DOUBLE, kind STRING, detail STRING",
}

MANIFEST = (
    "schemaVersion INT, id STRING, startedAt DOUBLE, endedAt DOUBLE, clockAnchor DOUBLE, startClock DOUBLE, "
    "device STRUCT<model:STRING,systemVersion:STRING,name:STRING,hasLiDAR:BOOLEAN,attitudeReferenceFrame:STRING>, "
    "config STRUCT<captureMode:STRING,stillsHz:DOUBLE,stillQuality:DOUBLE,recordDepth:BOOLEAN,recordConfidence:BOOLEAN,detectPlanes:BOOLEAN,videoFPS:INT,depthHz:DOUBLE,motionHz:DOUBLE,"
    "videoBitrate:INT,useMagnetometerCorrection:BOOLEAN,degradeOnThermalPressure:BOOLEAN,formatPreference:STRING,lockFocus:BOOLEAN>, "
    "video STRUCT<file:STRING,width:INT,height:INT,codec:STRING,nominalFPS:INT,bitrate:INT,firstFramePTS:DOUBLE>, "
    "counts MAP<STRING,BIGINT>, appVersion STRING, appBuild STRING, terminationReason STRING"
)
