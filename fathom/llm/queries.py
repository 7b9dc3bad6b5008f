"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir), and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .decontamination import decontaminate
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .html_extract import extract
from .merkle import MerkleManifest, leaf, proof_digest, verified
from .ngram_join import similarity_components
from .packing import pack_documents
from .pii import KINDS, span_list, with_pii
from .sharding import shard_by_bytes
from .token_store import write_tokens
from .warc import write_archive

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, divisor: int) -> Column:
    """crc32 of a number's decimal text, modulo divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _remainder("id", 5) != 0)
    predicted = toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return predicted.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(_table(spark, sf_dir, "pages"))
    return archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, _remainder("doc_id", 4) != 2)
    return language_id.identify(docs, model).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_spans")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, capacity=1024)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID).read().select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13, percent=5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", label, "embedding", positives=5, negatives=10)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = leaf("doc_id", "source", "lang", "n_chars", F.replace("text", F.lit("\n"), F.lit("")))
    whole = leaf(*MANIFEST_COLUMNS)
    altered = F.when(_remainder("doc_id", 2) == 0, tampered).otherwise(whole)
    manifest = MerkleManifest.build(docs, MANIFEST_COLUMNS, "doc_id", "source", keep={"altered": altered})
    found = verified(manifest.proofs(), manifest.root, F.col("keep_altered"))
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "subroot")}
    return found.select(F.col("id").alias("doc_id"), hexed["digest"].alias("leaf"), hexed["subroot"].alias("subroot"), F.lit(manifest.root).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _counter(name: str) -> Callable[[Column, Column], Column]:
    return lambda n, span: n + F.when(span["kind"] == name, 1).otherwise(0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), column="pii").select("doc_id", "pii", F.filter("pii", lambda s: s["base"]).alias("base"))
    counts = [F.aggregate("base", F.lit(0).cast("long"), _counter(k.name)).alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_output": op9_token_output,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pii": op13_pii,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLE_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"
_TEST_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FOUR_BITS = "".join(f"{i:04b}" for i in range(16))
_FIVE_BITS = "".join(f"{i:05b}," for i in range(32))

#: Base kinds, with their patterns and the test of a match m. The tables have no span of the other kinds; those have tests.
_PII = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255"),
    "card": ("[0-9]([ -]?[0-9])+", "len(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 - 9 * (c::INT > 4)::INT END)) % 10 = 0"),
    "phone": ("[+][0-9][ ().0-9-]+[0-9]", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
}
_PII_SQL = f"""
    WITH k(o, kind, pattern) AS (VALUES {", ".join(f"({i}, '{k}', '{p}')" for i, (k, (p, _)) in enumerate(_PII.items()))}),
    a AS (SELECT doc_id, o, kind, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS ps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), k),
    b AS (SELECT doc_id, o, kind, unnest(ms) AS m, unnest(ps[:len(ms)]) AS piece, unnest(range(len(ms))) AS i FROM a),
    c AS (SELECT doc_id, o, kind, m, sum(len(piece) + len(m)) OVER (PARTITION BY doc_id, o ORDER BY i)::BIGINT AS e FROM b),
    f AS (SELECT doc_id, o, kind, e - len(m) AS s, e FROM c WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {test}" for k, (_, test) in _PII.items())} END),
    g AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII)} FROM f GROUP BY 1)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(coalesce(text, '')) AS text_sha256
              FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))
    """,
    "op3_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT one, two FROM c JOIN n x ON x.doc_id = one JOIN n y ON y.doc_id = two WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.two FROM reach JOIN link ON link.one = reach.seen)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
    """,
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
        b AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('{_FOUR_BITS}', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((strpos('{_FIVE_BITS}', substr(bits, 5 * i + 1, 5) || ',') - 1) // 6 + 1)::INT, 1)), '') AS payload_digest FROM b
    """,
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS s FROM documents),
        f AS (SELECT doc_id, s, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
            text, replace(text, chr(10), '') AS cut FROM d),
        l AS (SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS cut_leaf,
            list_reduce([4294967295::UBIGINT::BIGINT] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: [ascii(c)::BIGINT] || list_transform(range(8), lambda i: -1::BIGINT))),
                lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        tree(s, k, nodes) AS (SELECT s, 0, list(leaf ORDER BY pos) FROM p GROUP BY s UNION ALL
            SELECT s, k + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1),
        sub AS (SELECT s, nodes[1] AS subroot, row_number() OVER (ORDER BY s) - 1 AS place FROM tree WHERE len(nodes) = 1),
        top(k, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL
            SELECT k + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM top WHERE len(nodes) > 1),
        lv AS (SELECT s, k, nodes FROM tree WHERE len(nodes) > 1 UNION ALL SELECT s, 1000 + k, nodes FROM sub, top WHERE len(nodes) > 1),
        pl AS (SELECT p.doc_id, p.s, p.pos, lv.k, lv.nodes, (CASE WHEN lv.k >= 1000 THEN sub.place // (3 ** (lv.k - 1000))::BIGINT ELSE p.pos // (3 ** lv.k)::BIGINT END) AS i FROM p JOIN lv USING (s) JOIN sub USING (s)),
        st AS (SELECT s, pos, k, array_to_string(nodes[i // 3 * 3 + 1:i], '') AS lft, array_to_string(nodes[i + 2:i // 3 * 3 + 3], '') AS rgt FROM pl),
        pr AS (SELECT s, pos, list({'l': lft, 'r': rgt} ORDER BY k) AS steps FROM st GROUP BY s, pos),
        fold(s, pos, done, acc) AS (SELECT s, pos, 0, CASE WHEN crc % 2 = 1 THEN cut_leaf ELSE leaf END FROM p UNION ALL
            SELECT fold.s, fold.pos, done + 1, sha256(steps[done + 1].l || acc || steps[done + 1].r) FROM fold JOIN pr ON pr.s = fold.s AND pr.pos = fold.pos WHERE done < len(steps))
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256, acc AS folded_root, acc = root AS verified
        FROM p JOIN sub USING (s) LEFT JOIN pr ON pr.s = p.s AND pr.pos = p.pos JOIN (SELECT s, pos, max_by(acc, done) AS acc FROM fold GROUP BY ALL) g ON g.s = p.s AND g.pos = p.pos, (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
    """,
    "op13_pii": _PII_SQL,
    "op10_decontamination": f"""
        WITH t AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_TEST_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        tw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
        d AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM tw))),
        m AS (SELECT DISTINCT doc_id, item_id, k, i FROM dw JOIN tw USING (k, s)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
        n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
