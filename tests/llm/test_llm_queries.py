"""The ten queries and the pipeline on the smallest tables, against SQL or counts."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare, connect  # noqa: E402

from veldspar.llm import entry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", entry.QUERIES)
def test_query(spark, name):
    df = entry.QUERIES[name](spark, SF)
    if name in entry.ORACLE_SQL:
        compare(connect(SF), df, entry.ORACLE_SQL[name])
        return
    table = {"op3_main_text": "pages", "op8_chat_windows": "conversations"}.get(name, "documents")
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    assert df.count() == (source.select("conv_id").distinct().count() + 1 if table == "conversations" else source.count())
