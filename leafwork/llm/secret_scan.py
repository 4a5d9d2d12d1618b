"""Secret scans by an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds which rule has seen which blob, and the findings. Only pairs of blob and rule
that it hasn't are scanned, each blob once however many paths and versions hold it, and findings are joined back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import PIECE, SMALL, checkpointed, join_by_weight, shared_dir, written

SEEN = "blob string, rule string"
FINDINGS = "blob string, rule string, kind string, start long, end long"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters are dropped. A changed rule needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which spans of one start are listed. A maximal run of 32 hexadecimal characters or more, or of AKIA and
#: 12 characters or more, is the same match as a longer pattern's with short ones dropped, as both take whole runs.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: What the operator adds: private keys, signed web tokens, bearer headers and tokens with a provider's prefix.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", 1, r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("prefixed", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)
RULES = BASE + MORE


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def pairs_unseen(blobs: DataFrame, seen: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, _todo: for each of the distinct ``blobs`` the names of the rules that haven't seen it; blobs that all have seen aren't there."""
    names = F.array(*(F.lit(r.name) for r in rules))
    if seen is None:
        return blobs.select("blob", names.alias("_todo"))
    had = seen.groupBy("blob").agg(F.collect_set("rule").alias("_had"))
    todo = blobs.select("blob").join(had, "blob", "left").select("blob", F.array_except(names, F.coalesce("_had", F.array().cast("array<string>"))).alias("_todo"))
    return todo.filter(F.size("_todo") > 0)


def matches_of(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (FINDINGS) of ``texts`` (blob, _text, _todo): a text is cut at the matches, so spans are sums of lengths, in code points.

    What a text yields is exploded and summed within the text; no array grows inside a fold.
    """
    found = []
    for r in rules:
        whole = F.when(F.array_contains("_todo", r.name), F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0)))
        found.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.lit(r.pattern).alias("pattern"), F.lit(r.group).alias("group"), whole.alias("whole")))
    # most texts have no match: only the others are cut
    some = texts.select("blob", "_text", F.filter(F.array(*found), lambda x: F.size(x["whole"]) > 0).alias("_found")).filter(F.size("_found") > 0)
    by_rule = some.select("blob", "_text", F.explode("_found").alias("_f")).select("blob", "_text", "_f.*")
    cut = by_rule.select(
        "blob", "rule", "kind", "least",
        F.posexplode(F.arrays_zip(
            F.transform("whole", lambda m: F.length(m).cast("long")).alias("size"),
            F.transform(F.split("_text", F.col("pattern"), -1), lambda g: F.length(g).cast("long")).alias("gap"),
            F.transform(F.regexp_extract_all("_text", F.col("pattern"), F.col("group")), lambda g: F.length(g)).alias("judged"),
        )),
    ).select("blob", "rule", "kind", "least", "pos", "col.*")
    so_far = W.partitionBy("blob", "rule").orderBy("pos")
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    spans = cut.withColumn("end", end).filter(F.col("judged") >= F.col("least"))
    return spans.select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(versions: DataFrame, seen: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, blobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new findings (FINDINGS) and the newly seen pairs (SEEN), both written tables, of ``versions`` (blob, _text; any number of rows a blob).

    ``blobs`` has the digests of ``versions`` where they were written before. First digests alone are brought together, then the texts of blobs with an unseen pair, one of each task's copies; where few are unseen, as in a later
    commit, the others' texts are left out before the shuffle.
    """
    blobs = (versions if blobs is None else blobs).select("blob").distinct()
    todo = written(pairs_unseen(blobs, seen, rules))
    fresh = versions
    if seen is not None and todo.count() <= SMALL:
        fresh = versions.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    texts = fresh.groupBy("blob").agg(F.first("_text").alias("_text")).join(todo.hint("merge"), "blob")
    return written(matches_of(texts, rules)), todo.select("blob", F.explode("_todo").alias("rule"))


class Ledger:
    """A ledger as Parquet in a folder that executors share: one folder a commit for findings and one for seen pairs.

    A commit writes its findings first and its seen pairs, which make it count, last; a commit that broke off in between is taken anew and its findings aren't read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _read(self, what: str, schema: str) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/seen")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return None
        # commits are few (one a run), their names short
        done = [s.getPath().getName() for s in files.listStatus(hadoop) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{what}/{name}" for name in sorted(done))) if done else None

    def seen(self) -> DataFrame | None:
        return self._read("seen", SEEN)

    def findings(self) -> DataFrame:
        found = self._read("findings", FINDINGS)
        return self.spark.createDataFrame([], FINDINGS) if found is None else found

    def commit(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, blobs: DataFrame | None = None) -> int:
        """Scans what no earlier commit has seen of ``versions`` (blob, _text); returns how many pairs of blob and rule those were."""
        found, pairs = scan(versions, self.seen(), rules, blobs)
        name = uuid.uuid4().hex
        found.write.parquet(f"{self.path}/findings/{name}")
        pairs.write.parquet(f"{self.path}/seen/{name}")
        return pairs.count()


def addressed(docs: DataFrame, *more: str) -> DataFrame:
    """``more``, _text (null: empty) and blob of each row; other columns aren't read."""
    return docs.select(*more, F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("blob", blob_of(F.col("_text")))


def at_paths(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (any columns and blob) with ``found``: an array of (start, kind's place in ``rules``, end, kind), ordered so; empty where there is none.

    Blobs of very many paths are split among tasks by counts of paths, also where they have no findings.
    """
    place = F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("rule")).cast("int")
    by_blob = findings.filter(place > 0).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("found"))
    blobs = paths.groupBy("blob").agg(F.count("*").alias("_paths")).join(by_blob, "blob", "left")
    some = blobs.filter(F.col("found").isNotNull() | (F.col("_paths") > PIECE))
    some = checkpointed(some)
    total = paths.count()
    out = join_by_weight(paths, some, ["blob"], "_paths", total, F.xxhash64(*[c for c in paths.columns if c != "blob"], F.monotonically_increasing_id()))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return out.select(*paths.columns, F.coalesce("found", none).alias("found"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda x: x["kind"].isin(*kinds))


def secret_scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``, a commit to the ``ledger`` (a new one by default).

    Spans are those of all ``rules``, by start and then by the rules' order; the counts and base_sha256 are of the base kinds. Every row is a path, repeated
    rows and null doc_ids too. A null text is the empty one; it, and any text without a secret, has counts of 0, empty spans and the digest of
    nothing. Texts are scanned whole however long. Columns other than doc_id and text aren't read. An empty table gives no rows.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    rows = addressed(docs, "doc_id")
    paths = written(rows.select("doc_id", "blob"))
    ledger.commit(rows.select("blob", "_text"), rules, paths)
    out = at_paths(paths, ledger.findings(), rules)
    n = [F.size(of_kinds(F.col("found"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = of_kinds(F.col("found"), *(r.kind for r in BASE))
    return out.select("doc_id", *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
