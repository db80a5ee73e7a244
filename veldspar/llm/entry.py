"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_main, importance, jaccard_join, mixing, personal_data, phrases, quality_rank, quality_rules, secret_scan, token_counts, token_files
from .shared import fresh_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hit_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), root, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.digests(spark, root)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"), keep=("url",))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), vocabulary=tokenizer_path("byte_bpe_50k.json"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality_rank.score(docs.select("doc_id", "text"), quality_rank.train(docs, labels, threshold=0.3))
    held = F.coalesce(quality_rank.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    path = fresh_dir(spark, "chat")
    chat.windows(turns.unionByName(more)).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top(*phrases.mine(_table(spark, sf_dir, "documents"), least=10, most_words=3, inside_percent=50), most=2000)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"].isin(*personal_data.BASE)))
    return found.select("doc_id", *[count(k) for k in personal_data.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed="42")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_files, op3_main_text, op4_secret_scan, op5_quality_rank,
        op6_quality_rules, op7_ngram_jaccard, op8_chat_windows, op9_source_mix, op10_token_counts,
        op11_phrases, op12_personal_data, op13_importance,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STOPS = ", ".join(f"'{v}'" for x in quality_rules.STOP_WORDS for v in dict.fromkeys((x, x.capitalize(), x.upper())))

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH lowered AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, (SELECT DISTINCT n FROM windows))),
        found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x USING (n, gram)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM lowered d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op6_quality_rules": rf"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        grams AS (SELECT doc_id, i, w[i : i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
        repeated AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams),
        covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM repeated WHERE c > 1) GROUP BY doc_id),
        m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                length(regexp_replace(text, '[^|]', '', 'g')) AS n_pipes, len(regexp_extract_all(text, '\p{{Lu}}{{2,}}')) AS n_capitals,
                len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words
            FROM split LEFT JOIN covered USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0 OR n_symbols / n_words > 0.5
                OR n_dup_lines / n_lines > 0.5 OR n_stop_words / n_words < 0.01 OR n_capitals / n_words > 0.5 OR n_pipes / n_words > 0.2) AS kept
        FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)""",
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op9_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
                [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
            FROM sources WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        planned AS (
            SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE max(CASE WHEN cap > level * w THEN level END) OVER () * w END AS target FROM levels),
        cutting AS (
            SELECT doc_id, size, p.source_size, target, round(target)::BIGINT AS budget,
                coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
        whole AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM cutting)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM whole""",
    "op11_phrases": r"""
        WITH cleaned AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cleaned),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
        grams AS (
            SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS v(m)) GROUP BY ALL),
        candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
            JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
            JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
        inside AS (
            SELECT lang, phrase, max(a) AS most FROM (
                SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM candidates WHERE m = 3
                UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE m = 3) GROUP BY lang, phrase),
        kept AS (
            SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM lowest JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
            WHERE place = 1 AND (most IS NULL OR 100 * most < 50 * a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM kept WHERE rank <= 2000""",
    "op13_importance": r"""
        WITH RECURSIVE steps(i, k, c) AS (
            SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) AS x(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
        bytes AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
        docs AS (
            SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        runs AS (
            SELECT place, array_to_string(w[i : i + m - 1], ' ') AS gram, count(*) AS n
            FROM (SELECT place, w, m, unnest(range(1, len(w) - m + 2)) AS i
                FROM (SELECT place, w FROM docs UNION ALL SELECT 0, w FROM items), (VALUES (1), (2), (3)) AS v(m)) GROUP BY ALL),
        hashed AS (
            SELECT gram, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(gram) + 1), lambda j: ('0x' || substr(hex(gram), 2 * j - 1, 2))::UBIGINT)),
                lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
            FROM (SELECT DISTINCT gram FROM runs), bytes),
        counts AS (
            SELECT b.bucket, coalesce(sum(n) FILTER (place > 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (place = 0), 0)::BIGINT AS t
            FROM range(10000) AS b(bucket) LEFT JOIN (hashed JOIN runs USING (gram)) h ON h.bucket = b.bucket GROUP BY b.bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
        weighed AS (SELECT place, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM runs JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE place > 0 GROUP BY place),
        scored AS (
            SELECT place, doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
            FROM docs LEFT JOIN weighed USING (place)),
        drawn AS (
            SELECT place, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, place) AS rank, count(*) OVER () AS n FROM scored WHERE eligible)
        SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT place, rank FROM drawn WHERE rank <= 5 * n // 100) USING (place)""",
}
