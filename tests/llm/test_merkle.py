"""The Merkle manifest against a plain list of levels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidings.llm import merkle

FIELDS = ["doc_id", "text"]
SCHEMA = "doc_id long, lang string, text string, tree string, place int, digest string, carried string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(digests, fanout):
    """(root, proofs): a proof is a list of (digests before, digests after)."""
    proofs, nodes, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        for proof, i in zip(proofs, at):
            run = i - i % fanout
            proof.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fanout])))
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def expected(rows, fanout):
    groups = {}
    for doc_id, lang, text in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, h(field(doc_id) + field(text)), doc_id))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree_of([r[2] for r in sorted(groups[g])], fanout) for g in names}
    root, above = tree_of([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above):
        for (_, _, leaf, doc_id), proof in zip(sorted(groups[g]), trees[g][1]):
            out.append((doc_id, leaf, trees[g][0], root, proof + up))
    return sorted(out, key=str)


def got(df, fanout):
    found = merkle.manifest(df, FIELDS, "lang", "doc_id", [F.col("doc_id"), F.col("digest")], fanout)
    step = F.transform("path", lambda s: F.struct(merkle.as_hex(s["left"]).alias("l"), merkle.as_hex(s["right"]).alias("r")))
    rows = found.select("carried.doc_id", *[merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], step.alias("p"),
                        merkle.proof_digest(F.col("path")).alias("proof"),
                        merkle.as_hex(merkle.fold(F.col("leaf"), F.col("path"))).alias("folded")).collect()
    for r in rows:
        assert r["folded"] == r["root"] and r["proof"] == h("".join(s["l"] + s["r"] for s in r["p"]))
    return sorted(((r[0], r[1], r[2], r[3], [tuple(s) for s in r["p"]]) for r in rows), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", "c") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("fanout", [2, 8])
def test_equals_plain_levels(spark, fanout):
    rows = [(i, "en", f"text {i}") for i in range(75)] + [(i, "fr", None) for i in range(8)]
    rows += [(3, "de", "x" * 100_000), (None, None, ""), (1, None, "é"), (None, "en", "null id"), (4, "", "empty group")]
    rows += [(5, "en", "same id, another text"), (6, "en", "text 6"), (6, "en", "text 6")]  # ties and equal rows
    assert got(table(spark, rows), fanout) == expected(rows, fanout)


def test_a_third_of_equal_rows_and_many_groups(spark):
    rows = [(7, "en", "copy")] * 40 + [(i, f"lang {i % 30}", "t") for i in range(80)]
    assert got(table(spark, rows), 8) == expected(rows, 8)


def test_lone_leaf_and_empty_table(spark):
    assert got(table(spark, [(1, "en", "a")]), 8) == expected([(1, "en", "a")], 8)
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, FIELDS, "lang", "doc_id").count() == 0


def test_a_changed_leaf_leads_elsewhere(spark):
    rows = [(i, "en", f"Text {i}") for i in range(20)]
    claimed = F.when(F.col("doc_id") == 3, merkle.leaf_digest(F.col("doc_id"), F.lower("text")))
    found = merkle.manifest(table(spark, rows), FIELDS, "lang", "doc_id", [F.col("doc_id"), claimed.alias("claimed")])
    folded = merkle.fold(F.coalesce("carried.claimed", "leaf"), F.col("path"))
    wrong = found.filter(folded != F.col("root")).select("carried.doc_id").collect()
    assert [r[0] for r in wrong] == [3]
