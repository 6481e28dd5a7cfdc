from __future__ import annotations

import re

from pyspark.sql import functions as F

from perigee.llm import blob_ledger
from perigee.llm.shared import shared_folder

RULES = {
    "assign": (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
KEY = "AKIA" + "Z" * 16
TEXTS = [
    f"password = 'hunter22' and {KEY} end",
    "token=short token: long_enough",
    "secret=token =abcdefgh",
    "ſecret=abcdefgh PASSWORD:abcdef apiKEY=\"aaaaaa\" api_key==bbbbbb",
    "é🙂" * 10 + "0123456789abcdef0123456789abcdef" + "G" + "a" * 24,
    "AKIAAKIA" + "Q" * 12 + " AKIA123",
    "token=" + "0123456789abcdef" * 4 + " token=x" * 300,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "A1" * 20 + " https://me:pw@host",
    None,
    "",
]


def plain(text):
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        flags = re.I | re.A if kind == "assign" else 0
        for m in re.finditer(pattern, text or "", flags):
            if len(m.group(group)) >= least:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_spans_against_re(spark, awkward):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").unionAll(awkward.select("doc_id", "text"))
    found = blob_ledger.scan(docs, shared_folder(spark)).select("doc_id", blob_ledger.written(blob_ledger.of_kinds("found", ("assign", "access", "hex"))).alias("s"))
    got = sorted(((r["doc_id"], r["s"]) for r in found.collect()), key=str)
    assert got == sorted(((r["doc_id"], plain(r["text"])) for r in docs.collect()), key=str)


def test_only_unseen_pairs_are_scanned(spark):
    folder = shared_folder(spark)
    rows = [("a", 1, TEXTS[0]), ("a", 2, TEXTS[4]), ("b", 1, TEXTS[0])]
    first = spark.createDataFrame(rows, "path string, version int, text string")
    scan = lambda frame, rules: blob_ledger.scan(frame, folder, rules, ("path", "version"))
    one = scan(first, blob_ledger.BASE)
    assert {(r["path"], r["version"], len(r["found"])) for r in one.collect()} == {("a", 1, 2), ("a", 2, 2), ("b", 1, 2)}
    runs = lambda: spark.read.parquet(f"{folder}/runs/*").select("blob", F.explode("rules").alias("rule"))
    assert runs().count() == 2 * 3
    scan(first.unionAll(spark.createDataFrame([("c", 1, TEXTS[7])], first.schema)), blob_ledger.BASE)
    assert runs().count() == 3 * 3
    every = scan(first, blob_ledger.BASE + blob_ledger.MORE[:1])
    assert runs().count() == 3 * 3 + 2 and runs().distinct().count() == runs().count()
    assert sum(len(r["found"]) for r in every.collect()) == 6
    newer = (blob_ledger.Rule("hex", 2, "[0-9a-f]+", 0, 30),)
    again = {(r["path"], r["version"]): [s["start"] for s in r["found"]] for r in scan(first, newer).collect()}
    assert again == {("a", 1): [], ("a", 2): [20], ("b", 1): []}


def test_a_bumped_rule_within_the_whole_set(spark):
    folder = shared_folder(spark)
    docs = spark.createDataFrame([(1, TEXTS[4]), (2, TEXTS[0]), (3, "f" * 27)], "doc_id bigint, text string")
    where = lambda rules: {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in blob_ledger.scan(docs, folder, rules).collect()}
    old = where(blob_ledger.RULES)
    bumped = tuple(blob_ledger.Rule("hex", 2, "[0-9a-f]+", 0, 30) if r.kind == "hex" else r for r in blob_ledger.RULES)
    new = where(bumped)
    assert old[1] == [("hex", 20, 52), ("hex", 53, 77)] and new[1] == [("hex", 20, 52)]
    assert old[3] == [("hex", 0, 27)] and new[3] == [] and new[2] == old[2]
    # the versions of a kind stay apart, in either order, also after the runs were folded
    assert where(blob_ledger.RULES) == old
    blob_ledger.compact(spark, folder)
    rows = spark.read.parquet(f"{folder}/runs/*")
    assert rows.count() == 3 and {len(r["rules"]) for r in rows.collect()} == {len(bumped) + 1}
    assert where(bumped) == new and where(blob_ledger.RULES) == old
    assert spark.read.parquet(f"{folder}/runs/*").count() == 3


def test_halves_over_one_folder_equal_a_scan_of_all(spark, awkward):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").unionAll(awkward.select("doc_id", "text"))
    folder = shared_folder(spark)
    blob_ledger.scan(docs.where("doc_id % 2 = 0"), folder)
    key = lambda frame: sorted(map(str, frame.collect()))
    assert key(blob_ledger.scan(docs, folder)) == key(blob_ledger.scan(docs, shared_folder(spark)))


def test_further_kinds_against_re(spark, awkward):
    samples = [
        "-----BEGIN PRIVATE KEY-----\n-----BEGIN EC PRIVATE KEY----- -----BEGIN KEY-----",
        "é eyJ" + "a" * 9 + ".eyJ" + "b_-" * 4 + ".sig-1 eyJshort.eyJshort.x",
        "ghp_" + "A1" * 20 + " gho_" + "z" * 36 + " ghx_" + "z" * 40 + " ghu_" + "z" * 35,
        "🙂xoxb-0123456789 xoxc-0123456789 xoxp-a",
        "ftp://me:pw@host https://a:@b git+ssh://u:" + "p" * 256 + "@h http://u:" + "p" * 257 + "@h",
    ]
    docs = awkward.select("doc_id", "text", "found", "blob").unionAll(
        spark.createDataFrame([(100 + k, s, "x", "y") for k, s in enumerate(samples)], "doc_id bigint, text string, found string, blob string")
    )
    rows = blob_ledger.scan(docs, shared_folder(spark), blob_ledger.MORE).collect()
    plain_more = lambda text: sorted((m.start(), k, r.kind, m.end()) for k, r in enumerate(blob_ledger.MORE) for m in re.finditer(r.pattern, text or ""))
    want = sorted(str((r["doc_id"], [(a, k, e) for a, _, k, e in plain_more(r["text"])])) for r in docs.collect())
    assert sorted(str((r["doc_id"], [(s["start"], s["kind"], s["end"]) for s in r["found"]])) for r in rows) == want
    assert sum(len(r["found"]) for r in rows) >= 8


def test_native_plan_and_empty(spark, nothing):
    found = blob_ledger.scan(nothing, shared_folder(spark))
    assert found.count() == 0
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())


def test_redacted(spark):
    spans = "array(named_struct('start', 2L, 'end', 5L), named_struct('start', 3L, 'end', 4L), named_struct('start', 7L, 'end', 8L))"
    frame = spark.sql(f"SELECT 'ab🙂defghij' AS t, {spans} AS s")
    assert frame.select(blob_ledger.redacted(F.col("t"), F.col("s"))).first()[0] == "ab[secret]fg[secret]ij"
