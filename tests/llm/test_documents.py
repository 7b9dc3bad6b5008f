"""Operators over documents: brute force, exact round trips, and the cases that every operator must take."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import decontamination
from fathom.llm.bpe import WordCacheEncoder
from fathom.llm.decontamination import WindowIndex, clean_documents, decontaminate, remove_spans, words_of
from fathom.llm.exact_dedup import ExactDedup, exact_duplicates
from fathom.llm.members import may_match, without
from fathom.llm.ngram_join import similarity_components
from fathom.llm.packing import pack_documents, plan_bins
from fathom.llm.partenum import PartEnum
from fathom.llm.queries import END_ID, ORACLES, QUERIES, tokenizer_path
from fathom.llm.sharding import balance, grow, grow_map, read_map, shard_by_bytes
from fathom.llm.shingles import shingle_sets
from fathom.llm.token_store import write_tokens
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, digest int, n int, size string, bucket int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [(1, "a b c d e"), (2, None), (3, ""), (4, "a b c d e"), (5, " \n\t "), (6, LONG), (7, "été 漢字 😀 ok"), (8, "x"), (8, "x"), (None, "a b c d e"), (9, "a b c d e f")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, blanks, a very long text, repeated rows, and columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "clash", 0, 1, None, 2) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup
def test_exact_dedup_equals_sql(spark):
    same_rows(spark, QUERIES["op1_exact_dedup"], ORACLES["op1_exact_dedup"], SF)


def _groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, top[t or ""], len(by[t or ""]), i == top[t or ""]) for i, t in rows), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_edges_and_colliding_digests(edge, weak):
    more = {"digest": lambda c: F.lit("same").cast("binary")} if weak else {}
    found = exact_duplicates(edge, **more)
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=str) == _groups(ROWS)


def test_exact_dedup_remembers_earlier_arrivals(spark, edge, nothing):
    run = ExactDedup(spark, files_per_batch=1)
    run.ingest(edge.where("doc_id <= 4"))
    run.ingest(edge.where("doc_id > 4 or doc_id is null").repartition(3))
    assert {(r["keep_id"], r["rows"]) for r in run.state().collect()} == {(g[1], g[2]) for g in _groups(ROWS)}
    assert exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_resolves_the_second_arrival_alone(spark, weak):
    rows = [(9, "a"), (2, "b"), (7, "c"), (1, "a"), (3, "b"), (4, "d"), (None, None), (5, "")]
    first, second = (spark.createDataFrame(part, "doc_id long, text string") for part in (rows[:3], rows[3:]))
    run = ExactDedup(spark, **({"digest": lambda c: F.lit("same").cast("binary")} if weak else {}))
    run.ingest(first)
    run.ingest(second)
    ids = {i for i, _ in rows[3:]}
    assert sorted((tuple(r)[:4] for r in run.resolve(second).collect()), key=str) == [g for g in _groups(rows) if g[0] in ids]


def test_exact_dedup_runs_no_python(spark):
    plan = QUERIES["op1_exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- near duplicates
WORD, LOWER = re.compile("[^\x20\x09-\x0d]+"), str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(rows, percent=85):
    parent = {}
    sets = [(i, shingles(t)) for i, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _ in rows:
        parent[i] = i
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a & b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


def _near(df):
    return sorted((tuple(r) for r in similarity_components(df).collect()), key=str)


def test_shingle_sets_are_those_of_the_definition():
    r = random.Random(2)
    texts = [None, "", "A b", "É x É x É x É x", *("".join(r.choices("ab XÉ\t\n\x0b\x1f\xa0", k=r.randint(0, 60))) for _ in range(300))]
    assert [len(s) for _, s in shingle_sets(texts, 4)] == [len(shingles(t)) for t in texts]


def patterned(n, swap=False):
    """A word of a and b that a polynomial hash cannot tell from the one with both swapped."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if swap else word


@pytest.mark.parametrize("n", [1024, 4096, 262_144])
def test_words_that_meet_in_a_polynomial_hash_stay_apart(n, library):
    texts = [f"q {patterned(n, s)} z" for s in (False, True)]
    one, two = (set(s.tolist()) for _, s in shingle_sets(texts, 2))
    assert len(one) == len(two) == 2 and not one & two
    got = dict(WordCacheEncoder(tokenizer_path()).encode([*texts, " ".join(texts)]))
    assert [got[i].tolist() for i in range(3)] == [library.library.encode(t, add_special_tokens=False).ids for t in (*texts, " ".join(texts))]


def test_hits_of_the_piece_cache_are_compared(library, monkeypatch):
    monkeypatch.setattr("fathom.llm.bpe.slice_hashes", lambda chars, starts, ends: np.full(len(starts), 7, dtype=np.uint64))
    texts = ["one two three", "three two one", " one", "x" * 300 + " y"]
    got = dict(WordCacheEncoder(tokenizer_path()).encode(texts))
    assert [got[i].tolist() for i in range(4)] == [library.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr("fathom.llm.bpe.CHUNK_CHARS", 50)
    r = random.Random(3)
    texts = ["".join(r.choices(["word", " ", "  ", "\n", "'s", "12", "é", "漢", "!", " a", "\u2009"], k=400)) for _ in range(40)]
    got = dict(WordCacheEncoder(tokenizer_path()).encode(texts))
    assert [got[i].tolist() for i in range(40)] == [library.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for g in range(14):
        base = [f"{g}w{r.randrange(500)}" for _ in range(r.choice((3, 6, 9, 25, 60, 150)))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(words) // 14)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: len(words) - r.randint(0, len(words) // 12)])))
    r.shuffle(rows)
    got = _near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == components(rows) and len({x[2] for x in got}) < len(rows)


def test_near_duplicates_edges(edge, nothing):
    got = _near(edge)
    assert [x for x in got if x[0] is not None] == [x for x in components(ROWS) if x[0] is not None]
    assert (None, 2, None) in got and similarity_components(nothing).count() == 0


def test_near_duplicates_on_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _near(docs) == components([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_similar_sets_share_a_signature_and_pass_the_sketch(percent):
    r, scheme = np.random.default_rng(1), PartEnum(percent)
    for _ in range(400):
        size = int(r.integers(1, 260))
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        drop = int(r.integers(0, max(1, size * (100 - percent) // 100 + 1)))
        b = np.unique(np.concatenate((a[drop:], r.integers(0, 2**64, int(r.integers(0, max(1, drop + 1))), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= percent * (len(a) + len(b) - common):
            assert set(scheme.signatures(a)[0]) & set(scheme.signatures(b)[0])
            for i in set(scheme.instances(len(a))) & set(scheme.instances(len(b))):
                x, y = (np.frombuffer(scheme.sketch(s), dtype=np.uint8)[scheme.part_of_sketch(len(s), i)] for s in (a, b))
                assert scheme.differing(x, y) <= scheme.allowed(len(a), len(b))


# --- filters by key
def test_member_filters(spark, edge):
    some = spark.createDataFrame([(1,), (8,), (None,)], "k int")
    assert {r["doc_id"] for r in may_match(edge, "doc_id", some, "k").collect()} >= {1, 8}
    left = without(edge, "doc_id", some, "k")
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, _ in ROWS if i not in (1, 8)), key=str) and left.columns == edge.columns


# --- sharding
def test_sharding(spark, edge, nothing):
    rows = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(4000)], "doc_id long, text string")
    out, slots = shard_by_bytes(rows, n_shards=7)
    out = out.collect()
    load, places = Counter(), defaultdict(list)
    for r in out:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        text = "x" * (r["id"] * 37 % 900)
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text.encode()))
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(load) == 7
    assert max(load.values()) - min(load.values()) <= max(r["bytes"] for r in slots.collect())
    got, _ = shard_by_bytes(edge, n_shards=3)
    assert sorted(r["size"] for r in got.collect()) == sorted(len((t or "").encode()) + 8 for _, t in ROWS)
    assert shard_by_bytes(nothing)[0].count() == 0


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = [(v, 100 + v % 17, 1) for v in range(2000)]
    before = balance(sizes, 8)
    after = grow(sizes, before, 8)
    load = Counter()
    for v, b, _ in sizes:
        assert after[v] in (before[v], 8)
        load[after[v]] += b
    assert len(load) == 9 and max(load.values()) < 1.05 * min(load.values())


def test_records_are_placed_by_a_grown_map(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(4000)], "doc_id long, text string")
    root = f"file://{tmp_path}/map"
    before, first = shard_by_bytes(rows, n_shards=7, map_root=root)
    grown = grow_map(spark, root)
    assert {r["version"] for r in first.collect()} == {1} and {r["version"] for r in read_map(spark, root).collect()} == {2}
    assert sorted(map(tuple, read_map(spark, root, 1).collect())) == sorted(map(tuple, first.collect()))
    after, used = shard_by_bytes(rows, slot_map=grown)
    where = {r["vslot"]: r["shard"] for r in grown.collect()}
    old, new = ({r["id"]: r for r in df.collect()} for df in (before, after))
    load, places = Counter(), defaultdict(list)
    for i, r in new.items():
        assert r["shard"] == where[r["vslot"]] and r["shard"] in (old[i]["shard"], 7)
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values()) and {r["version"] for r in used.collect()} == {2}
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    more = rows.unionAll(spark.createDataFrame([(10_000 + i, "new") for i in range(3000)], rows.schema))
    assert all(r["shard"] == where.get(r["vslot"], r["shard"]) for r in shard_by_bytes(more, slot_map=grown)[0].collect())


# --- tokens
@pytest.fixture(scope="module")
def library():
    return WordCacheEncoder(tokenizer_path())


def _ids(library, text):
    return np.array([*library.library.encode(text or "", add_special_tokens=False).ids, END_ID], dtype="<u4")


def test_cached_encoding_is_the_library_s(library):
    r = random.Random(1)
    alphabet = list("ab'sStmdrevl 12\n\t .,é漢 　​͸😀²Ⅷǆ͸ß-!<|>'")
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 25))) for _ in range(2000)] + ["<|endoftext|> it's we'll '  's \n'll", "", " ", "'s", LONG]
    assert [ids.tolist() for _, ids in library.encode(texts)] == [e.ids for e in library.library.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer(spark, library):
    fresh = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's<|endoftext|><|endoftext|>\n x", "<|endoftext|", "endoftext|> <|", "été <|endoftext|>²", "plain <| text"]
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for _, ids in library.encode(texts * 2)] == want * 2 and want[0] == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = sorted(write_tokens(docs, tokenizer_path(), END_ID).read().collect(), key=lambda r: r["doc_id"])
    data = [np.array([*ids, END_ID], dtype="<u4") for ids in want]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in rows] == [(len(d), zlib.crc32(d.tobytes())) for d in data]
    packed = pack_documents(docs, tokenizer_path(), END_ID).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packed} == {i: (len(d), zlib.crc32(d.tobytes())) for i, d in enumerate(data)}


def test_packing(spark, edge, nothing, library):
    out = [r.asDict() for r in pack_documents(edge, tokenizer_path(), END_ID).collect()]
    want = Counter((i, len(_ids(library, t))) for i, t in ROWS)
    total, bins = Counter(), defaultdict(list)
    for r in out:
        total[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] == 6:
            ids = _ids(library, LONG)[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 1024)
    assert total == Counter({i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in want})
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(nothing, tokenizer_path(), END_ID).count() == 0


def test_bin_plan_uses_each_piece_once_and_is_tight():
    r = random.Random(9)
    counts = Counter(r.choice((r.randint(1, 60), r.randint(200, 1024))) for _ in range(5000))
    plan = plan_bins(dict(counts), 1024)
    used = Counter()
    for lengths, times in plan.bins:
        assert sum(lengths) <= 1024
        used.update({x: n * times for x, n in Counter(lengths).items()})
    assert used == counts
    assert plan.n_sequences <= 1.02 * max(-(-sum(x * n for x, n in counts.items()) // 1024), sum(n for x, n in counts.items() if x > 512))
    assert plan_bins({}, 1024).n_sequences == 0 and plan_bins({512: 3}, 1024).n_sequences == 2


def test_token_files_round_trip(spark, edge, nothing, library):
    stored = write_tokens(edge.repartition(3), tokenizer_path(), END_ID, bytes_per_file=1 << 16)
    rows = sorted(stored.read().collect(), key=lambda r: r["start"])
    at, texts = 0, defaultdict(set)
    for i, t in ROWS:
        texts[i].add(t or "")
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    for r in rows:
        (text,) = texts[r["doc_id"]]
        ids = _ids(library, text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = rows[len(rows) // 2]
    assert stored.document(some["path"], some["position"]).tolist() == _ids(library, next(iter(texts[some["doc_id"]]))).tolist()
    assert write_tokens(nothing, tokenizer_path(), END_ID).read().count() == 0


# --- decontamination
def _windows(items, width):
    found = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            found[tuple(w[a : a + k])].add(str(i))
    return found


def _scan(text, windows):
    w = words_of(text)
    hit, names = [False] * len(w), set()
    for size in {len(k) for k in windows}:
        for a in range(len(w) - size + 1):
            if own := windows.get(tuple(w[a : a + size])):
                names |= own
                hit[a : a + size] = [True] * size
    return hit, names


def test_automaton_equals_brute_force():
    r = random.Random(6)
    for _ in range(250):
        make = lambda n: " ".join(r.choice("abcd") for _ in range(n))
        items = [(i, r.choice((None, "", make(r.randint(1, 12))))) for i in range(r.randint(0, 6))]
        index, windows, text = WindowIndex(items, 5), _windows(items, 5), make(r.randint(0, 60))
        hit, numbers = index.scan(words_of(text))
        want, names = _scan(text, windows)
        assert hit.tolist() == want and {n for i in numbers for n in index.items[i]} == names


@pytest.mark.parametrize("most", [decontamination.MOST_ITEM_BYTES, 9])  # one block of items, and several
def test_decontamination_edges(spark, edge, nothing, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_ITEM_BYTES", most)
    items = spark.createDataFrame([(10, "A b, c d e", "x"), (9, "a-B c d e", "x"), (11, "漢字 😀", "y"), (12, None, None), (12, "", None)], "item_id long, text string, doc_id string")
    windows = _windows([tuple(r)[:2] for r in items.collect()], 13)
    got = [r.asDict() for r in decontaminate(edge, items, cleaned=True).collect()]
    assert len(got) == len(ROWS)
    for r, (i, t) in zip(sorted(got, key=lambda r: str((r["doc_id"], r["n_words"]))), sorted(ROWS, key=lambda x: str((x[0], len(words_of(x[1]))))), strict=True):
        hit, names = _scan(t, windows)
        assert (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (i, len(hit), sum(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest())
        assert r["contaminated"] == (sum(hit) > 0 and 20 * sum(hit) >= len(hit)) and (r["contaminated"] or r["cleaned"] == t)
    assert {r["cleaned"] for r in got if r["doc_id"] == 9} == {" f"}
    assert decontaminate(nothing, items).count() == 0 and decontaminate(edge, items.limit(0)).where("n_hit > 0").count() == 0
    assert remove_spans("One, two three; four", np.array([False, True, True, False])) == "One, ; four"


def test_blocks_of_items_unite_their_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d x x", "p"), (2, "c d", None), (3, "x y " * 50 + "a b", "q"), (4, None, "r"), (4, "b c d", "s")], "doc_id long, text string, `hits.names` string")
    items = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d"), (4, "a b"), (5, None)], "item_id long, text string")
    whole, kept = decontaminate(docs, items).collect(), clean_documents(docs, items)
    monkeypatch.setattr(decontamination, "MOST_ITEM_BYTES", 3)
    assert sorted(decontaminate(docs, items).collect()) == sorted(whole)
    assert {r["n_hit"] for r in whole if r["doc_id"] == 1} == {4} and {r["n_items"] for r in whole if r["doc_id"] == 1} == {4}
    parts = clean_documents(docs, items)
    assert parts.columns == docs.columns and sorted(parts.collect(), key=str) == sorted(kept.collect(), key=str)
