"""Secret scan with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds,
run by run, which blobs were scanned with which rule versions and what was found. A
scan reads the ledger, searches only pairs of blob and rule version that it lacks,
appends them, and joins findings back to all paths. All of it is DataFrame work.

Positions: Spark's regular expressions return matches without their places. Splitting
by the same expression gives what lies between them; the running lengths of both are
the places, in code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import rows_of

SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"
STORED = "array<struct<rule:string,start:bigint,end:bigint>>"  # as the ledger has them


def either_case(word: str) -> str:
    """Letters of the word in either case; spelled out, as engines fold differently."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind; matches whose group is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")

# The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, "[0-9a-f]+", 0, 24),
)

# Formats that the base does not cover.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge", 1, r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@"),
)
RULES = BASE + MORE

# Each is implied by a match and found faster than the whole pattern.
_HINTS = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}


def spans(text: Column, rule: Rule) -> Column:
    """All matches of a rule: leftmost, not overlapping, the short ones dropped."""
    hits = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    groups = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
    lengths = F.arrays_zip(
        F.transform(between, lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(hits, lambda x: F.length(x).cast("long")).alias("size"),
        F.transform(groups, lambda x: F.length(x).cast("long")).alias("group"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(STORED).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        here = F.struct(F.lit(rule.name).alias("rule"), begin.alias("start"), (begin + x["size"]).alias("end"))
        out = F.when(x["group"] >= rule.least, F.concat(state["out"], F.array(here))).otherwise(state["out"])
        return F.struct((begin + x["size"]).alias("at"), out.alias("out"))

    found = F.aggregate(lengths, start, step, lambda s: s["out"])
    return F.when(text.rlike(_HINTS.get(rule.kind, rule.pattern)), found).otherwise(F.array().cast(STORED))


def _runs(spark, folder: str) -> list[str]:
    """The directories of the finished runs."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS"))
    return sorted(status.getPath().getParent().toString() for status in done or [])


def _ledger(spark, folder: str) -> DataFrame | None:
    """What the finished runs wrote, or None before the first."""
    runs = _runs(spark, folder)
    return spark.read.schema(f"blob string, rules array<string>, found {STORED}").parquet(*runs) if runs else None


def _append(rows: DataFrame, folder: str) -> None:
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/runs/run={uuid.uuid4().hex}")


def compact(spark, folder: str) -> None:
    """Fold the finished runs into one with a row for each blob, then remove them.

    A scan before or after gives the same result; so does a ledger that holds the old
    runs beside the new one, as after a break between the two steps. Not to be run while
    a scan reads the same folder.
    """
    old = _runs(spark, folder)
    if len(old) < 2:
        return
    every = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
    _append(_ledger(spark, folder).groupBy("blob").agg(every("rules"), every("found")), folder)
    for run in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(run)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Findings of every row of `versions`: the path columns, blob and found (spans).

    `folder` holds the ledger and may be empty or absent; a run adds one directory with
    the pairs it scanned, complete or not at all. Rows that repeat and versions with
    equal texts are one blob. A null text counts as empty. Spans are ordered by start,
    then rule order; start and end are code points, end exclusive. Every finding is held
    with its rule and version: those of others than asked for stay in the ledger and out
    of the result.
    """
    spark = versions.sparkSession
    keys = {f"path{k}": name for k, name in enumerate(path_cols)}
    rows = rows_of(versions, **keys, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    names = [rule.name for rule in rules]
    blobs = rows.select("blob", "text").dropDuplicates(["blob"])
    before = _ledger(spark, folder)
    if before is None:
        todo = blobs.withColumn("todo", F.lit(None).cast("array<string>"))
    else:
        done = before.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        lacking = F.array_except(F.array(*map(F.lit, names)), F.coalesce("done", F.array().cast("array<string>")))
        todo = blobs.join(done, "blob", "left").withColumn("todo", lacking).where(F.size("todo") > 0)
    parts = []
    for rule in rules:
        due = F.col("todo").isNull() | F.array_contains("todo", rule.name)
        parts.append(F.when(due, spans(F.col("text"), rule)).otherwise(F.array().cast(STORED)))
    scanned = todo.select(
        "blob",
        F.coalesce("todo", F.array(*map(F.lit, names))).alias("rules"),
        F.concat(*parts).alias("found"),
    )
    _append(scanned, folder)
    asked = F.array(*map(F.lit, names))
    wanted = F.transform(
        F.filter("found", lambda s: F.array_contains(asked, s["rule"])),
        lambda s: F.struct(
            s["start"],
            F.array_position(asked, s["rule"]).cast("int").alias("place"),
            F.substring_index(s["rule"], "@", 1).alias("kind"),
            s["end"],
        ),
    )
    found = _ledger(spark, folder).where(F.size("found") > 0).select("blob", F.explode(wanted).alias("span"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("found"))
    out = rows.drop("text").join(found, "blob", "left")
    return out.select(*[F.col(k).alias(n) for k, n in keys.items()], "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def of_kinds(found: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by a mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.when(x["start"] >= s["at"], piece).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        )

    done = F.aggregate(found, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
