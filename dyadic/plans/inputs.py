"""The given tables in the shape of the operators: pairs, entities, scored rows, run records.

Each builder has a SQL twin used by the reference queries. Every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.operators.pairs import PairData, last_write
from dyadic.operators.splits import split_pairs
from dyadic.session import cut_lineage

# (l_orderkey, l_linenumber) alone is not unique in the given data.
ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity"]
DIGITS = 9


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r9(column, digits: int = DIGITS):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def dense_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("a"), F.col("event_type").alias("b"), "value", "event_id"
    )
    return last_write(rows, ["a", "b"], "value", ["event_id"])


DENSE = """dense as (select cast(user_id as varchar) a, event_type b, arg_max(value, event_id) y
 from events group by 1, 2)"""


def item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), *ITEM_ORDER
    )
    return last_write(rows, ["a", "b"], "l_quantity", ITEM_ORDER)


ITEM_ORDER_DESC = ", ".join(f"{c} desc" for c in ITEM_ORDER)
ITEMS = f"""items as (select a, b, y from (select cast(l_partkey as varchar) a, cast(l_suppkey as varchar) b,
 l_quantity y, row_number() over (partition by l_partkey, l_suppkey order by {ITEM_ORDER_DESC}) rn
 from lineitem) where rn = 1)"""


def labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return item_pairs(spark, folder).withColumn("y", (F.col("y") >= 25.0).cast("double"))


LABELLED = ITEMS + """, labelled as (select a, b, case when y >= 25 then 1.0::double else 0.0::double end y from items)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("content")
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("content")
    )


def item_data(spark: SparkSession, folder: str, split: bool = True) -> PairData:
    """Labelled part-supplier pairs with names as entity texts; written once, since models read them often."""
    pairs = cut_lineage(labelled_pairs(spark, folder))
    if split:
        pairs = split_pairs(pairs)
    return PairData(pairs, parts(spark, folder), suppliers(spark, folder))


def folds(source: str, keys: str = "a || '|' || b", name: str = "folds", seed: int = 42, ratio: float = 0.2) -> str:
    """SQL of the random split of a pair CTE."""
    return f"""{name} as (select a, b, y, case when row_number() over (order by md5('{seed}|' || {keys}))
 <= n - greatest(1, round_even(n * {ratio}, 0)) then 'train' else 'test' end fold
 from {source}, (select count(*) n from {source}) c)"""


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000.0).alias("y_hat")
    )


METRIC_ROWS = "m as (select l_quantity y, l_extendedprice / 2000.0::double y_hat from lineitem)"


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("y"), ((F.col("n_chars") % 100) / 100.0).alias("y_hat")
    )


SCORE_ROWS = """s as (select doc_id, quality::double y, (n_chars % 100) / 100.0::double y_hat
 from documents join labels using (doc_id))"""


def hash_list(text: str, width: int = 16) -> str:
    """SQL of the L2-normed code point histogram as a list."""
    counts = f"list_transform(range({width}), lambda i: len(list_filter(string_split({text}, ''), lambda c: unicode(c) % {width} = i))::double)"
    return f"list_transform({counts}, lambda x: x / sqrt(list_sum(list_transform({counts}, lambda z: z * z))))"


def gaussian_sql(text: str) -> str:
    """SQL of the normal derived from ``md5(text)``."""
    low, high = (f"('0x' || substr(md5({text}), {s}, 8))::bigint" for s in (1, 9))
    return f"(sqrt(-2.0 * ln(({low} + 1) / 4294967296.0::double)) * cos(2.0 * pi() * ({high} / 4294967296.0::double)))"


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """One run record per event: name, path, and metric texts, some of which are not numbers."""
    events = table(spark, folder, "events")
    pick = lambda names, by: F.get(F.array(*[F.lit(n) for n in names]), (F.col(by) % len(names)).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat_ws("_", F.lit("PAIR"), F.lit("EVAL"), F.upper("event_type"),
                    pick(["RANDOM", "COLD_DRUG", "COLD_TARGET"], "user_id"),
                    pick(["FULL", "NO_CAUSAL", "NO_IRM", "NO_CF", "NO_MAS"], "event_id"),
                    F.concat(F.lit("S"), (k % 3 + 10).cast("string"))).alias("run_name"),
        F.format_string("runs/%012d/summary.json", "event_id").alias("summary_path"),
        F.when(k % 10 == 0, "nan").when(k % 10 == 1, "n/a").otherwise(F.format_string("%.5f", F.col("value") / 500)).alias("ci"),
        F.format_string("%.4f", F.col("value") / 100).alias("rmse"),
        F.when(k % 7 == 0, "FAILED").otherwise("PASS").alias("status"),
        "event_id",
    )


_PICK_SPLIT = "['RANDOM','COLD_DRUG','COLD_TARGET'][(user_id % 3) + 1]"
_PICK_ABLATION = "['FULL','NO_CAUSAL','NO_IRM','NO_CF','NO_MAS'][(event_id % 5) + 1]"
_K = "cast(json_extract_string(props, '$.k') as int)"
RUNS = f"""runs as (select 'PAIR_EVAL_' || upper(event_type) || '_' || {_PICK_SPLIT} || '_' || {_PICK_ABLATION} || '_S' ||
 cast({_K} % 3 + 10 as varchar) run_name, printf('runs/%012d/summary.json', event_id) summary_path,
 case when {_K} % 10 = 0 then 'nan' when {_K} % 10 = 1 then 'n/a' else printf('%.5f', value / 500) end ci,
 printf('%.4f', value / 100) rmse, case when {_K} % 7 = 0 then 'FAILED' else 'PASS' end status, event_id
 from events)"""
IDENTITY = """ident as (select *, string_split(run_name, '_') t, len(string_split(run_name, '_')) n from runs),
 named as (select * exclude (t, n), case when n < 6 then 'UNKNOWN' else t[3] end dataset,
 case when n < 6 then 'UNKNOWN' when n - 4 >= 3 and t[4] = 'COLD' then t[4] || '_' || t[5] else t[4] end split,
 case when n < 6 then 'UNKNOWN' when n - 4 >= 3 and t[4] = 'COLD' then array_to_string(t[6:n-1], '_')
 when n - 4 = 1 then 'UNKNOWN' else array_to_string(t[5:n-1], '_') end ablation,
 case when n < 6 then 'UNKNOWN' else regexp_replace(t[n], '^S+', '') end seed from ident)"""
NUM = "nullif(try_cast({c} as double), 'nan'::double)"


def num(column: str) -> str:
    return NUM.format(c=column)


def corr_sql(rows: str, x: str, y: str) -> str:
    """Pearson correlation as a scalar subquery of plain centred sums."""
    return f"""(select sum(({x} - ex) * ({y} - ey)) / sqrt(sum(pow({x} - ex, 2)) * sum(pow({y} - ey, 2)))
 from {rows}, (select avg({x}) ex, avg({y}) ey from {rows}))"""
