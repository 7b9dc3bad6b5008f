"""The Merkle manifest against a tree built by hand."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fathom.llm import merkle
from fathom.llm.merkle import MerkleManifest, fold, leaf, proof_digest, verified
from fathom.llm.queries import MANIFEST_COLUMNS, ORACLES, QUERIES
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, group string, pos int, digest string, id string"


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, place, arity=3):
    out = []
    for level in levels[:-1]:
        run, own = level[place // arity * arity : place // arity * arity + arity], place % arity
        out.append(("".join(run[:own]), "".join(run[own + 1 :])))
        place //= arity
    return out


def by_hand(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof digest) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for k in keys}
    trees = {k: tree([leaf_of(r) for r in ordered[k]], arity) for k in keys}
    top = tree([trees[k][-1][0] for k in keys], arity)
    out = []
    for i, k in enumerate(keys):
        for place, r in enumerate(ordered[k]):
            proof = steps(trees[k], place, arity) + steps(top, i, arity)
            out.append((r[0], trees[k][0][place], trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in proof))))
    return sorted(out, key=str)


def manifest_rows(manifest):
    found = manifest.proofs().select("id", F.lower(F.hex("digest")), F.lower(F.hex("subroot")), F.lit(manifest.root), proof_digest(F.col("proof")))
    return sorted(map(tuple, found.collect()), key=str)


def test_query_equals_sql(spark):
    same_rows(spark, QUERIES["op12_merkle_manifest"], ORACLES["op12_merkle_manifest"], SF)


def rows_of(seed, n):
    r = random.Random(seed)
    texts = [None, "", "a", "a\nb", "é\n\n", "x" * 70_000]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "b", "é", "\U0001f600", "￿"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice(texts)) for _ in range(n)]
    return rows + rows[:5]  # equal rows are leaves of their own


@pytest.mark.parametrize("n, arity, rank_rows", [(1, 3, 9), (60, 3, 7), (60, 2, 1000), (4, 5, 2)])
def test_manifest_by_hand(spark, monkeypatch, n, arity, rank_rows):
    monkeypatch.setattr(merkle, "RANK_ROWS", rank_rows)
    rows = rows_of(n, n)[: n if n == 1 else None]
    docs = spark.createDataFrame([(*r, "clash", 1, "x", "y") for r in rows], SCHEMA)
    manifest = MerkleManifest.build(docs, MANIFEST_COLUMNS, "doc_id", "source", arity=arity)
    assert manifest_rows(manifest) == by_hand(rows, arity)
    assert verified(manifest.proofs(), manifest.root, F.col("digest")).where("not verified").count() == 0


def test_saved_manifest_tells_changed_rows(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "en", i, f"text {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    built = MerkleManifest.build(docs, MANIFEST_COLUMNS, "doc_id", "source")
    built.save(f"file://{tmp_path}/manifest")
    kept = MerkleManifest.load(spark, f"file://{tmp_path}/manifest")
    assert kept.root == built.root and manifest_rows(kept) == by_hand(rows)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("text"))).select(F.col("doc_id").alias("id"), leaf(*MANIFEST_COLUMNS).alias("now"))
    told = verified(kept.proofs().join(changed, "id"), kept.root, F.col("now"))
    assert {r["id"] for r in told.where("not verified").collect()} == {0, 7, 14, 21, 28}


def test_tampering_only_cuts_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    cut = {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")}
    assert {r["doc_id"] for r in QUERIES["op12_merkle_manifest"](spark, SF).where("not verified").collect()} == cut != set()


def test_empty_table(spark):
    manifest = MerkleManifest.build(spark.createDataFrame([], SCHEMA), MANIFEST_COLUMNS, "doc_id", "source")
    assert manifest.root is None and manifest.proofs().count() == 0


def test_fold_of_no_steps_is_the_leaf(spark):
    row = spark.range(1).select(fold(F.unhex(F.lit("ab" * 32)), F.array().cast(merkle._STEP)).alias("x")).first()
    assert row["x"] == "ab" * 32
