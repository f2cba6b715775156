"""Jobs on reading, admitting, profiling and encoding frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform, null_if_nan, rounded, sorted_json
from ..functions.storage import fresh_path, stored
from ..operators import contract, profile
from ..sources import io
from ..spec import Feature, Problem
from .frames import HOLES_SQL, LINE, LINE_SQL, PRIORITIES, SEED, _uniform, holes, line, read
from .registry import job

CATEGORICAL = ["l_returnflag", "l_linestatus", "o_orderpriority"]
NUMERIC = ["l_quantity", "l_discount", "l_tax", "p_size"]


@job("SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def read_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and parquet by suffix: orders are written as CSV with a declared schema and read back."""
    path = fresh_path(spark, "read_frame") + ".csv"
    frame = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    frame.write.csv(path, header=True)
    return io.read_frame(spark, path, frame.schema).withColumn("o_totalprice", F.round("o_totalprice", 2))


@job("SELECT o_orderdate::TIMESTAMP AS ds, round(o_totalprice, 2) AS y FROM orders")
def read_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_series(spark, f"{sf_dir}/orders.parquet", "o_orderdate", "o_totalprice").select("ds", rounded("y", 2).alias("y"))


@job(f"WITH {LINE_SQL} SELECT key, l_returnflag, round(y, 6) AS y FROM line WHERE l_quantity <= 50")
def freeze_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = line(spark, sf_dir).where("l_quantity <= 50").select("key", "l_returnflag", "y")
    return io.freeze(admitted, fresh_path(spark, "freeze")).select("key", "l_returnflag", rounded("y").alias("y"))


@job("""
    SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS title, len(string_split(regexp_extract(text, '^([^\n]*)', 1), ' ')) AS n_tags,
        length(text) - length(regexp_extract(text, '^([^\n]*)', 1)) AS body_chars
    FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3""")
def load_markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter and body of documents, whose first lines are put as title and tags before them; one block in ten is never closed."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    body = F.expr("substring(text, length(regexp_extract(text, '^([^\\n]*)', 1)) + 1)")
    end = F.when(F.col("doc_id") % 10 == 3, "]\n").otherwise("]\n---")
    text = F.concat(F.lit("---\ntitle: "), title, F.lit("\ntags: ["), F.regexp_replace(title, " ", ", "), end, F.when(F.col("doc_id") % 10 == 3, F.regexp_replace(body, "\n---", "\n")).otherwise(body))
    parsed = io.parse_front_matter(docs.select("doc_id", text.alias("text")), "text", tag_separator=", ")
    return parsed.select("doc_id", F.col("meta")["title"].alias("title"), F.size("tags").cast("long").alias("n_tags"), F.length("body").cast("long").alias("body_chars"))


_TYPED = Problem(
    (Feature("k", "numeric", minimum=0, maximum=60), Feature("event_type", "categorical", ("click", "purchase", "view")), Feature("value", "numeric", minimum=0, maximum=50, nullable=True)),
    Feature("label", "numeric"),
)
_RAW_SQL = "raw AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE props->>'k' END AS k, event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS value, CASE WHEN event_id % 13 <> 0 THEN user_id END AS label FROM events)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.when(id_ % 50 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")).alias("k"), "event_type", F.when(id_ % 9 != 0, F.col("value")).alias("value"), F.when(id_ % 13 != 0, F.col("user_id")).alias("label"))


@job(f"WITH {_RAW_SQL} SELECT event_id, TRY_CAST(k AS DOUBLE) AS k, event_type, round(value, 6) AS value, label::DOUBLE AS label FROM raw")
def coerce_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.coerce(_raw(spark, sf_dir), _TYPED).withColumn("value", rounded("value"))


_VIOLATIONS = f"""{_RAW_SQL},
    broken AS (
        SELECT 'k' AS "column", 'dtype' AS "check", event_id AS row FROM raw WHERE k IS NOT NULL AND TRY_CAST(k AS DOUBLE) IS NULL
        UNION ALL SELECT 'k', 'minimum', event_id FROM raw WHERE TRY_CAST(k AS DOUBLE) < 0
        UNION ALL SELECT 'k', 'maximum', event_id FROM raw WHERE TRY_CAST(k AS DOUBLE) > 60
        UNION ALL SELECT 'k', 'null', event_id FROM raw WHERE k IS NULL
        UNION ALL SELECT 'event_type', 'level', event_id FROM raw WHERE event_type NOT IN ('click', 'purchase', 'view')
        UNION ALL SELECT 'event_type', 'null', event_id FROM raw WHERE event_type IS NULL
        UNION ALL SELECT 'value', 'minimum', event_id FROM raw WHERE value < 0
        UNION ALL SELECT 'value', 'maximum', event_id FROM raw WHERE value > 50
        UNION ALL SELECT 'label', 'null', event_id FROM raw WHERE label IS NULL)"""


@job(f'WITH {_VIOLATIONS} SELECT "column", "check", row FROM broken')
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.violations(_raw(spark, sf_dir), _TYPED, "event_id").select("column", "check", "row")


@job(f"""
    WITH {_VIOLATIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY "column", "check" ORDER BY row) AS nth FROM broken)
    SELECT "column", "check", count(*) AS n, string_agg(row::VARCHAR, ',' ORDER BY row) FILTER (nth <= 20) AS examples, greatest(count(*) - 20, 0) AS n_more FROM ranked GROUP BY 1, 2""")
def contract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.violation_summary(contract.violations(_raw(spark, sf_dir), _TYPED, "event_id"))


_AUDITED = Problem(
    (Feature("l_returnflag", "categorical", ("A", "R")), Feature("l_tax", "numeric"), Feature("l_quantity", "numeric"), Feature("key", "categorical", ("x",)), Feature("l_shipdate", "datetime")), Feature("y", "numeric")
)


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL},
    c AS (
        SELECT 'l_returnflag' AS "column", 'categorical' AS kind, 2 AS n_levels, count(*) AS n_rows, count(*) - count(l_returnflag) AS n_null, count(DISTINCT l_returnflag) AS n_unique FROM holed
        UNION ALL SELECT 'l_tax', 'numeric', 0, count(*), count(*) - count(l_tax), count(DISTINCT l_tax) FROM holed
        UNION ALL SELECT 'l_quantity', 'numeric', 0, count(*), count(*) - count(l_quantity), count(DISTINCT l_quantity) FROM holed
        UNION ALL SELECT 'key', 'categorical', 1, count(*), count(*) - count(key), count(DISTINCT key) FROM holed
        UNION ALL SELECT 'l_shipdate', 'datetime', 0, count(*), count(*) - count(l_shipdate), count(DISTINCT l_shipdate) FROM holed
        UNION ALL SELECT 'y', 'numeric', 0, count(*), count(*) - count(y), count(DISTINCT y) FROM holed),
    s AS (SELECT *, round(n_null / n_rows, 6) AS null_share, round(n_unique / n_rows, 6) AS cardinality_share FROM c)
    SELECT "column", n_rows, n_null, null_share, n_unique, cardinality_share,
        concat_ws('; ', CASE WHEN n_unique <= 1 THEN 'constant' END, CASE WHEN null_share >= 0.5 THEN 'mostly null' END,
            CASE WHEN kind = 'categorical' AND cardinality_share >= 0.5 THEN 'id-like' END, CASE WHEN n_levels > 0 AND n_unique > n_levels THEN 'more values than levels' END,
            CASE WHEN kind = 'datetime' THEN 'datetime' END, CASE WHEN n_null > 0 THEN 'null in non-nullable' END) AS issues
    FROM s""")
def column_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.column_audit(holes(line(spark, sf_dir)), _AUDITED)


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL} SELECT key, l_returnflag, CAST(l_linestatus AS VARCHAR) AS l_linestatus, CASE WHEN l_tax IS NULL THEN NULL ELSE CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS l_tax FROM holed""")
def cast_categoricals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holes(line(spark, sf_dir)).withColumn("l_tax", F.round(F.col("l_tax") * 100).cast("long"))
    return contract.coerce(null_if_nan(df.select("key", "l_returnflag", "l_linestatus", "l_tax")), Problem((Feature("l_returnflag", "categorical", ("A",)), Feature("l_linestatus", "categorical", ("F",)), Feature("l_tax", "categorical", ("0",))), Feature("y", "numeric")), target=False)


_ENCODED = replace(LINE, features=tuple(f for f in LINE.features if f.name in ("l_returnflag", "o_orderpriority", "l_quantity", "l_tax")))
_ONE_HOT = ", ".join(
    [f"CASE WHEN l_returnflag = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS l_returnflag_{x}" for x in ("A", "N", "R")]
    + [f"CASE WHEN o_orderpriority = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS {contract.level_column('o_orderpriority', x)}" for x in PRIORITIES]
)


@job(f"WITH {LINE_SQL} SELECT key, {_ONE_HOT}, l_quantity, round(l_tax, 6) AS l_tax FROM line")
def one_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.one_hot(line(spark, sf_dir), _ENCODED, ["key"]).withColumn("l_tax", rounded("l_tax"))


@job(f"WITH {LINE_SQL} SELECT key, l_quantity, 0.0::DOUBLE AS l_returnflag_Z, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END AS l_returnflag_A FROM line")
def align_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.align(contract.one_hot(line(spark, sf_dir), _ENCODED, ["key"]), ["key", "l_quantity", "l_returnflag_Z", "l_returnflag_A"])


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL}, f AS (SELECT median(l_tax) AS tax FROM holed WHERE l_shipdate < TIMESTAMP '1998-07-01')
    SELECT key, round(coalesce(l_tax, tax), 6) AS l_tax, l_returnflag, CASE WHEN l_tax IS NULL THEN 'l_tax' ELSE '' END AS imputed_features FROM holed, f""")
def impute_from_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holes(line(spark, sf_dir)).select("key", "l_tax", "l_returnflag", "l_shipdate")
    filled = contract.impute(df, df.where("l_shipdate < timestamp'1998-07-01'"), ["l_tax"], ["l_returnflag"])
    return filled.select("key", rounded("l_tax").alias("l_tax"), "l_returnflag", F.array_join("imputed_features", ",").alias("imputed_features"))


@job("""
    WITH m AS (SELECT o_orderkey, o_orderdate, count(*) OVER () AS n_matches FROM orders
        WHERE o_orderstatus = 'O' AND lower(concat_ws(chr(10), o_orderkey::VARCHAR, o_orderpriority)) LIKE '%urgent%')
    SELECT o_orderkey, n_matches FROM m ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def find_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filters, a case-insensitive substring, newest first, at most 25, with the count of all matches."""
    return io.find_records(read(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, ["o_orderkey", "o_orderpriority"], "URGENT", "o_orderdate", "o_orderkey").select("o_orderkey", "n_matches")


@job("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").isNotNull())
    return orders.select("o_orderkey", rounded("o_totalprice", 2).alias("o_totalprice"))


@job(f"WITH {LINE_SQL} SELECT key, l_returnflag, o_orderpriority, c_mktsegment, p_type, l_quantity, p_size, round(y, 6) AS y, round(pred, 6) AS pred FROM line")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line(spark, sf_dir).select("key", "l_returnflag", "o_orderpriority", "c_mktsegment", "p_type", "l_quantity", "p_size", rounded("y").alias("y"), rounded("pred").alias("pred"))


@job("""
    SELECT o_orderkey, count(*) AS n_readings, string_agg(l_linenumber || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_shipdate, l_linenumber, l_quantity) AS readings
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def readings_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_quantity")))
    text = F.transform(rows, lambda r: F.concat_ws(":", r.l_linenumber, r.l_quantity.cast("long")))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n_readings"), F.array_join(text, ",").alias("readings"))


_FKS = [("lineitem", "l_partkey", "part", "p_partkey", "p_size > 10"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "o_orderstatus <> 'P'"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "s_acctbal > 0"), ("orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0")]


@job(" UNION ALL ".join(f"SELECT '{f}.{k}' AS reference, count(*) AS n_orphans FROM {f} WHERE NOT EXISTS (SELECT 1 FROM {d} WHERE {i} = {k} AND {w})" for f, k, d, i, w in _FKS))
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference does not resolve; the dimensions are cut so that some do not."""
    found = None
    for fact, key, dim, id_, where in _FKS:
        part = io.orphans(read(spark, sf_dir, fact), key, read(spark, sf_dir, dim).where(where), id_, f"{fact}.{key}")
        found = part if found is None else found.unionByName(part)
    return found


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL}, u AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'p_size']) AS "column", unnest([l_quantity, l_discount, l_tax, p_size]) AS value FROM holed)
    SELECT "column", count(*) AS n_rows, count(*) - count(value) AS n_null, round((count(*) - count(value)) / count(*), 6) AS null_share, count(DISTINCT value) AS n_unique,
        round(count(DISTINCT value) / count(*), 6) AS cardinality_share, count(DISTINCT value) <= 1 AS constant, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
        CAST((2 * sum(CAST(round(value * 1e12) AS HUGEINT)) + count(value) * 1000000::HUGEINT) // (2 * count(value) * 1000000::HUGEINT) AS DOUBLE) / 1e6 AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median FROM u GROUP BY 1""")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile_numeric(holes(line(spark, sf_dir)), NUMERIC)
    shares = {"null_share": F.col("n_null") / F.col("n_rows"), "cardinality_share": F.col("n_unique") / F.col("n_rows")}
    return found.select("column", "n_rows", "n_null", "n_unique", (F.col("n_unique") <= 1).alias("constant"), *[rounded(x).alias(n) for n, x in shares.items()], *[rounded(c).cast("double").alias(c) for c in ("minimum", "maximum", "mean", "std", "median")])


@job(f"""
    WITH {LINE_SQL}, u AS (SELECT unnest(['l_returnflag', 'o_orderpriority', 'p_type']) AS "column", unnest([l_returnflag, o_orderpriority, p_type]) AS level FROM line),
    g AS (SELECT "column", level, count(*) AS n FROM u GROUP BY 1, 2),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS share, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS nth FROM g)
    SELECT "column", level, n, round(share, 6) AS share, nth, NULL::TIMESTAMP AS earliest, NULL::TIMESTAMP AS latest FROM r WHERE nth <= 10
    UNION ALL SELECT 'l_shipdate', NULL, count(l_shipdate), NULL, NULL, min(l_shipdate), max(l_shipdate) FROM line UNION ALL SELECT 'o_orderdate', NULL, count(o_orderdate), NULL, NULL, min(o_orderdate), max(o_orderdate) FROM line""")
def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest levels of categorical columns, and the range of times."""
    df = line(spark, sf_dir)
    levels = profile.top_levels(df, ["l_returnflag", "o_orderpriority", "p_type"]).withColumn("share", rounded("share"))
    return levels.unionByName(profile.time_ranges(df, ["l_shipdate", "o_orderdate"]), allowMissingColumns=True)


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props", "rare", "same"]
_EVENTS_SQL = "e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN user_id END AS rare, 'x' AS same FROM events)"


@job(f"""
    WITH {_EVENTS_SQL}, d AS (SELECT user_id, event_type, same, count(*) AS n FROM e GROUP BY 1, 2, 3), c AS (SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM d),
    s AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n, count({c}) AS known, count(DISTINCT {c}) AS u FROM e" for c in _EVENT_COLUMNS)}),
    f AS (SELECT c || ': ' || CASE WHEN u <= 1 THEN 'constant' WHEN 1 - known / n >= 0.5 THEN 'mostly null' WHEN u / n >= 0.5 THEN 'id-like' END AS finding FROM s)
    SELECT n_rows, 8::BIGINT AS n_columns, duplicate_rows, (SELECT string_agg(finding, '; ' ORDER BY finding) FROM f WHERE finding IS NOT NULL) AS findings FROM c""")
def profile_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("rare", F.when(F.col("event_id") % 3 == 0, F.col("user_id"))).withColumn("same", F.lit("x"))
    counts = profile.duplicate_rows(events, ["user_id", "event_type", "same"])
    findings = profile.findings(events, _EVENT_COLUMNS).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "column", "finding"))), "; ").alias("findings"))
    return counts.crossJoin(findings).select("n_rows", F.lit(len(_EVENT_COLUMNS)).cast("long").alias("n_columns"), "duplicate_rows", "findings")  # one row each


@job(f"""
    WITH {LINE_SQL}, {HOLES_SQL} SELECT 'l_tax' AS "column", round(1 - count(l_tax) / count(*), 6) AS null_share FROM holed
    UNION ALL SELECT 'l_quantity', round(1 - count(l_quantity) / count(*), 6) FROM holed""")
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missingness(holes(line(spark, sf_dir)), ["l_tax", "l_quantity"]).withColumn("null_share", rounded("null_share"))


@job("""
    WITH g AS (SELECT quality::VARCHAR AS level, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)
    SELECT level, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / sum(n) OVER (), 6) AS majority_share FROM g""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return profile.class_balance(labels, "quality").select("level", "n", rounded("share").alias("share"), rounded("majority_share").alias("majority_share"))


# What counts as an e-mail address and as a phone number.
_PII_EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
_PII_PHONE = r"(?:\+\d[\d\s().-]{7,}\d)|(?:\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b)"


@job(f"SELECT doc_id, regexp_matches(text, '{_PII_EMAIL}') AS has_email, regexp_matches(text, '{_PII_PHONE}') AS has_phone FROM documents")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(_PII_EMAIL).alias("has_email"), F.col("text").rlike(_PII_PHONE).alias("has_phone"))


_DELIVERED = "l_shipdate + INTERVAL 1 HOUR * (CASE WHEN l_partkey % 97 = 0 THEN -5 ELSE CAST(l_quantity AS INTEGER) END)"


@job(f"""
    WITH l AS (SELECT count(*) AS n_lines, bool_and(EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)) AS fk_ok, count(DISTINCT l_returnflag) = 3 AS levels_ok,
            count(*) FILTER (l_shipdate < o_orderdate) AS n_before_booking, count(*) FILTER ({_DELIVERED} < l_shipdate) AS n_before_dispatch, round(1 - count(NULLIF(l_tax, 0)) / count(*), 6) AS missing_share FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
        k AS (SELECT string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS level_counts FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)),
        d AS (SELECT count(*) FILTER (regexp_matches(text, '{_PII_EMAIL}') OR regexp_matches(text, '{_PII_PHONE}')) AS n_pii FROM documents),
        q AS (SELECT count(DISTINCT quality) = 2 AS classes_ok, count(*) AS n_labels, string_agg(quality || '=' || n, ',' ORDER BY quality) AS class_counts FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)),
        n AS (SELECT count(*) AS n_labelled FROM labels WHERE quality IS NOT NULL)
    SELECT n_lines, fk_ok, levels_ok, level_counts, n_before_booking, n_before_dispatch, missing_share, n_pii, classes_ok, class_counts, n_labelled,
        fk_ok AND levels_ok AND n_before_booking = 0 AND n_before_dispatch = 0 AND n_pii = 0 AND classes_ok AND n_labelled > 0 AS ok FROM l, k, d, q, n""")
def dataset_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys resolve, every level and class occurs, booking, dispatch and delivery are in order, no personal data, labels."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    parts = read(spark, sf_dir, "part").select("p_partkey").distinct().withColumn("known", F.lit(True))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    left = joined.agg(
        F.count("*").alias("n_lines"), F.bool_and(F.coalesce("known", F.lit(False))).alias("fk_ok"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_before_booking"),
        F.count_if(F.expr(_DELIVERED) < F.col("l_shipdate")).alias("n_before_dispatch"), rounded(1 - F.count(F.nullif("l_tax", F.lit(0.0))) / F.count("*")).alias("missing_share"),
    )
    levels = profile.level_counts(lines, "l_returnflag").select(F.col("text").alias("level_counts"), (F.col("n_levels") == 3).alias("levels_ok"))
    pii = read(spark, sf_dir, "documents").agg(F.count_if(F.col("text").rlike(_PII_EMAIL) | F.col("text").rlike(_PII_PHONE)).alias("n_pii"))
    classes = profile.level_counts(read(spark, sf_dir, "labels"), "quality").select(F.col("text").alias("class_counts"), (F.col("n_levels") == 2).alias("classes_ok"), F.col("n").alias("n_labelled"))
    ok = F.expr("fk_ok and levels_ok and n_before_booking = 0 and n_before_dispatch = 0 and n_pii = 0 and classes_ok and n_labelled > 0")
    return left.crossJoin(levels).crossJoin(pii).crossJoin(classes).withColumn("ok", ok)  # one row each


_LEAKY = ["l_quantity", "l_discount", "p_size", "settled", "copy"]


def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line(spark, sf_dir).withColumn("y", F.round("y", 2))
    return df.withColumn("settled", F.col("y") * 1.0001).withColumn("copy", F.concat(F.lit(" "), F.col("y").cast("decimal(12,2)").cast("string")))


_LEAKY_SQL = f"{LINE_SQL}, leaky AS (SELECT * REPLACE (round(y, 2) AS y), round(y, 2) * 1.0001 AS settled, ' ' || round(y, 2)::DECIMAL(12, 2)::VARCHAR AS copy FROM line)"


@job(f"""
    WITH {_LEAKY_SQL}, t AS (SELECT *, y::DECIMAL(12, 2)::VARCHAR AS yt FROM leaky)
    SELECT 'copy' AS feature, round(avg((lower(trim(copy)) = lower(trim(yt)))::INT), 6) AS share, avg((lower(trim(copy)) = lower(trim(yt)))::INT) >= 0.98 AS leaks FROM t
    UNION ALL SELECT 'l_returnflag', round(avg((lower(l_returnflag) = yt)::INT), 6), false FROM t""")
def leakage_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _leaky(spark, sf_dir).withColumn("yt", F.col("y").cast("decimal(12,2)").cast("string"))
    found = contract.duplicate_shares(df, ["copy", "l_returnflag"], "yt")
    return found.select("feature", rounded("share").alias("share"), (F.col("share") >= 0.98).alias("leaks"))


@job(f"WITH {_LEAKY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, y)), 6) AS correlation, abs(corr({c}, y)) >= 0.98 AS leaks FROM leaky" for c in _LEAKY[:4]))
def leakage_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contract.correlations(_leaky(spark, sf_dir), _LEAKY[:4], "y")
    return found.select("feature", rounded("correlation").alias("correlation"), (F.col("correlation") >= 0.98).alias("leaks"))


_FOLD = _uniform("key", SEED, "leakage")


@job(f"""
    WITH {LINE_SQL}, u AS (SELECT y AS t, {_FOLD} >= 0.25 AS train, unnest(['l_returnflag', 'o_orderpriority', 'c_mktsegment', 'p_type']) AS feature, unnest([l_returnflag, o_orderpriority, c_mktsegment, p_type]) AS bin FROM line),
    c AS (SELECT feature, bin, avg(t) FILTER (train) AS fit, count(*) FILTER (NOT train) AS n, sum(t) FILTER (NOT train) AS s, sum(t * t) FILTER (NOT train) AS ss FROM u GROUP BY 1, 2),
    m AS (SELECT feature, avg(t) AS mean FROM u WHERE train GROUP BY 1)
    SELECT feature, round(1 - sum(ss - 2 * coalesce(fit, mean) * s + n * coalesce(fit, mean) * coalesce(fit, mean)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS r2, sum(n)::BIGINT AS n_test
    FROM c JOIN m USING (feature) WHERE n > 0 GROUP BY 1""")
def leakage_single_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contract.single_feature_scores(line(spark, sf_dir), ["l_returnflag", "o_orderpriority", "c_mktsegment", "p_type"], "y", hash_uniform("key", SEED, "leakage") >= 0.25)
    return found.withColumn("r2", rounded("r2"))


_CLASS_LEAKY = ["l_returnflag", "o_orderpriority", "settled", "half"]


@job(f"""
    WITH {LINE_SQL}, k AS (SELECT *, CASE WHEN y < 36 THEN 'low' ELSE 'high' END AS truth FROM line), u AS (SELECT truth, {_FOLD} >= 0.25 AS train, unnest({_CLASS_LEAKY}) AS feature,
        unnest([l_returnflag, o_orderpriority, truth || '!', CASE WHEN {_uniform("key", SEED, "half")} < 0.5 THEN truth ELSE 'x' END]) AS bin FROM k),
    c AS (SELECT feature, bin, truth, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test FROM u GROUP BY 1, 2, 3),
    a AS (SELECT feature, truth, sum(n_train) AS n_train, sum(n_test) AS n_test FROM c GROUP BY 1, 2), m AS (SELECT feature, max_by(truth, (n_train, truth)) AS common, max(n_test) / sum(n_test) AS majority FROM a GROUP BY 1),
    f AS (SELECT feature, bin, CASE WHEN max(n_train) > 0 THEN max_by(truth, (n_train, truth)) END AS fit FROM c GROUP BY 1, 2),
    s AS (SELECT feature, sum(n_test) FILTER (truth = coalesce(fit, common)) / sum(n_test) AS accuracy, any_value(majority) AS majority FROM c JOIN f USING (feature, bin) JOIN m USING (feature) GROUP BY 1)
    SELECT feature, round(accuracy, 6) AS accuracy, round(majority, 6) AS majority, accuracy >= 0.98 AND accuracy > majority AS leaks FROM s WHERE feature <> 'o_orderpriority'""")
def leakage_single_feature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of each feature alone against the share of the commonest class; one feature is allowed to tell."""
    df = line(spark, sf_dir).withColumn("truth", F.when(F.col("y") < 36, "low").otherwise("high")).withColumn("settled", F.concat("truth", F.lit("!")))
    df = df.withColumn("half", F.when(hash_uniform("key", SEED, "half") < 0.5, F.col("truth")).otherwise("x"))
    found = contract.single_feature_accuracy(df, _CLASS_LEAKY, "truth", hash_uniform("key", SEED, "leakage") >= 0.25, allow=("o_orderpriority",))
    return found.select("feature", rounded("accuracy").alias("accuracy"), rounded("majority").alias("majority"), "leaks")


_BINNED = ["l_quantity", "l_discount", "p_size", "settled"]
_EDGES = ", ".join(str(i / 64) for i in range(1, 64))


@job(f"""
    WITH {_LEAKY_SQL}, edges AS (SELECT {", ".join(f"quantile_cont({c}, [{_EDGES}]) AS e_{c}" for c in _BINNED)} FROM leaky),
    u AS (SELECT y AS t, {_FOLD} >= 0.25 AS train, unnest({_BINNED}) AS feature, unnest([{", ".join(f"len(list_filter(list_distinct(e_{c}), lambda v: v <= {c}))" for c in _BINNED)}]) AS bin FROM leaky, edges),
    c AS (SELECT feature, coalesce(bin, -1) AS bin, avg(t) FILTER (train) AS fit, count(*) FILTER (NOT train) AS n, sum(t) FILTER (NOT train) AS s, sum(t * t) FILTER (NOT train) AS ss FROM u GROUP BY 1, 2),
    m AS (SELECT feature, avg(t) AS mean FROM u WHERE train GROUP BY 1)
    SELECT feature, round(1 - sum(ss - 2 * coalesce(fit, mean) * s + n * coalesce(fit, mean) * coalesce(fit, mean)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS r2, sum(n)::BIGINT AS n_test
    FROM c JOIN m USING (feature) WHERE n > 0 GROUP BY 1""")
def leakage_single_feature_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for numeric features between 63 exact quantiles."""
    df = stored(_leaky(spark, sf_dir).select("y", *_BINNED, (hash_uniform("key", SEED, "leakage") >= 0.25).alias("train")))
    found = contract.single_feature_scores(df, _BINNED, "y", F.col("train"))
    return found.withColumn("r2", rounded("r2"))


_DIGEST_TEXT = "concat_ws('|', l_orderkey, l_linenumber, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT))"


@job(f"""
    WITH r AS (SELECT sha256({_DIGEST_TEXT}) AS h, count(*) AS n FROM lineitem GROUP BY 1),
    a AS (SELECT substr(h, 1, 5) AS h, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS digest, sum(n) AS n FROM r GROUP BY substr(h, 1, 5)),
    b AS (SELECT substr(h, 1, 2) AS h, sha256(string_agg(h || ':' || digest, ',' ORDER BY h || ':' || digest)) AS digest, sum(n) AS n FROM a GROUP BY substr(h, 1, 2))
    SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(h || ':' || digest, ',' ORDER BY h || ':' || digest)) AS digest FROM b""")
def frame_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.expr(_DIGEST_TEXT).alias("row"))
    return profile.frame_digest(rows, "row")


@job("SELECT c_custkey, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":\"' || c_nationkey || '\",\"missing\":null}') AS feature_digest FROM customer")
def feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").withColumn("missing", F.lit(None).cast("string"))
    return df.select("c_custkey", F.sha2(sorted_json(["c_nationkey", "c_mktsegment", "missing"]), 256).alias("feature_digest"))


@job("""
    WITH d AS (SELECT event_type AS run_id, props->>'k' AS k, date_trunc('hour', ts) AS hour FROM events)
    SELECT run_id, k, count(*) AS n, count(DISTINCT hour) AS n_hours FROM d GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that were seen more than once, and in how many hours."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.get_json_object("props", "$.k").alias("k"), F.date_trunc("hour", "ts").alias("hour"))
    return events.groupBy("run_id", "k").agg(F.count("*").alias("n"), F.count_distinct("hour").alias("n_hours")).where("n > 1")


@job("""
    WITH s AS (SELECT l_orderkey, l_linenumber, date_diff('hour', date_trunc('hour', o_orderdate), date_trunc('hour', l_shipdate)) AS hours, 24 * 60 AS planned, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CASE WHEN l_linestatus = 'F' AND 100 * hours > 115 * planned THEN 'LATE' WHEN l_linestatus = 'O' AND hours > planned AND hours < 8760 THEN 'OVERDUE' ELSE 'ON TIME' END AS status, count(*) AS n, min(hours) AS least, max(hours) AS most FROM s GROUP BY 1""")
def transit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hours = ((F.unix_timestamp(F.date_trunc("hour", "l_shipdate")) - F.unix_timestamp(F.date_trunc("hour", "o_orderdate"))) / 3600).cast("long")
    status = F.when((F.col("l_linestatus") == "F") & (100 * F.col("hours") > 115 * 24 * 60), "LATE").when((F.col("l_linestatus") == "O") & (F.col("hours") > 24 * 60) & (F.col("hours") < 8760), "OVERDUE").otherwise("ON TIME")
    return joined.withColumn("hours", hours).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("hours").alias("least"), F.max("hours").alias("most"))
