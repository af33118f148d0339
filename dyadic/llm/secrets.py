"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they match. Weak parts (identifiers, short or unnamed secrets, endpoints) are
reported only where complementary parts stand together: an interval join finds, for each weak part, the other parts
whose distance is at most ``scope`` characters in the same document. A weak secret needs an identifier, an identifier
needs a secret, an endpoint needs both.

Matches are marked by a private-use character and their places are sums of lengths, so positions are code points. The
text is scanned once, where it is read; only spans of documents with complementary parts are joined, by document and
bin of ``scope`` characters, so that a document with very many parts is spread over its bins.

Defined cases: null and empty texts have no spans. Rows with equal ids are each judged alone. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.vectors import let
from dyadic.session import cut_lineage

MARK, OTHER = "\ue000", "\ue001"
SCOPE = 200
CHUNK = 256  # parts of a text between whose sums places are found; even, so that a chunk starts outside a match

# Patterns of the strong kinds. The value of an assignment is dropped afterwards if it is short; a run of
# one class has its least length in the pattern, which finds the same runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Patterns of the weak kinds.
IDENTIFIER = r"""((?i:user(?:name)?|login|account|client_?id|access_?key_?id|e-?mail))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
WEAK = r"""((?i:pass|pwd|pin|auth|credential|private_?key|secret_?access_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{3,})"""
ENDPOINT = r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|s3)://[A-Za-z0-9._~:/?#@!&=+%-]+|(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}"""
KINDS = ["assign", "access", "hex", "identifier", "weak", "endpoint"]
SECRETS, IDENTIFIERS = ["assign", "hex", "weak"], ["access", "identifier"]


def spans_of(text: Column, kind: str, pattern: str, least: int = 0) -> Column:
    """Array of (start, rank, end) of the leftmost matches that do not overlap; ``least`` bounds group 2.

    Places are sums of lengths, found for ``CHUNK`` parts at a time behind the sums of the chunks before them: an array
    that grew by one entry for each match of the whole text would be copied as often as there are matches.
    """
    rank = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def step(state, part):
        end = state["at"] + F.length(part)
        fits = state["odd"] & (F.length(F.regexp_extract(part, pattern, 2)) >= least) if least else state["odd"]
        found = F.array(F.struct(state["at"].alias("start"), rank.alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"), F.when(fits, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    def spans(parts: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
        chunk = lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK))
        sizes = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda n, x: n + F.length(x)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sizes, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        first = lambda at: F.struct(at.alias("at"), F.lit(False).alias("odd"), none.alias("out"))
        return let(starts, lambda at: F.flatten(F.transform(chunks, lambda c: F.aggregate(chunk(c), first(F.get(at, c)), step, lambda s: s["out"]))))

    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    return let(parts, lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(none))


def of_kinds(spans: str, kinds: list[str]) -> Column:
    ranks = [KINDS.index(k) for k in kinds]
    return F.filter(spans, lambda s: s["rank"].isin(ranks))


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Columns ``row`` (the kept ones), ``base`` (strong spans) and ``spans`` (also the linked weak ones), by start and kind."""
    clean = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), MARK, OTHER)
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), clean.alias("text"))
    found = texts.select(
        "row", F.concat(spans_of(F.col("text"), "assign", ASSIGN, 6), spans_of(F.col("text"), "access", ACCESS),
                        spans_of(F.col("text"), "hex", HEX)).alias("base"),
        F.concat(spans_of(F.col("text"), "identifier", IDENTIFIER), spans_of(F.col("text"), "weak", WEAK),
                 spans_of(F.col("text"), "endpoint", ENDPOINT)).alias("weak"))
    found = cut_lineage(found.select(F.monotonically_increasing_id().alias("n"), "row", F.array_sort("base").alias("base"), "weak"))
    return found.join(linked(found, scope), "n", "left").select(
        "row", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<start:int,rank:int,end:int>>")))).alias("spans"))


def linked(found: DataFrame, scope: int) -> DataFrame:
    """Weak parts with their complements in scope: rows (n, linked)."""
    everything = F.concat("base", "weak")
    mixed = found.where(F.size("weak") > 0).select("n", everything.alias("all")).where(
        (F.size(of_kinds("all", SECRETS)) > 0) & (F.size(of_kinds("all", IDENTIFIERS)) > 0))
    parts = mixed.select("n", F.explode("all").alias("s")).select("n", "s.*")
    rank = lambda kinds: F.col("rank").isin([KINDS.index(k) for k in kinds])
    weak = parts.where(rank(["identifier", "weak", "endpoint"])).withColumn(
        "bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    # complements by the bin of their start and of their end: an overlap shares one of the bins between
    other = parts.select("n", F.col("start").alias("b"), F.col("end").alias("e"), rank(SECRETS).alias("secret"), rank(IDENTIFIERS).alias("identifier"))
    other = other.where("secret or identifier").withColumn("bin", F.explode(F.sequence(F.floor(F.col("b") / scope), F.floor(F.col("e") / scope))))
    near = weak.join(other, ["n", "bin"]).where(
        (F.col("b") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope) & ((F.col("b") != F.col("start")) | (F.col("e") != F.col("end"))))
    roles = near.groupBy("n", "start", "rank", "end").agg(F.max("secret").alias("secret"), F.max("identifier").alias("identifier"))
    needs = (F.when(rank(["weak"]), F.col("identifier")).when(rank(["identifier"]), F.col("secret"))
             .otherwise(F.col("secret") & F.col("identifier")))
    return roles.where(needs).groupBy("n").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, name), ",")
