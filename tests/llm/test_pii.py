"""Personal data: the base kinds against Python's regular expressions, the others by hand, and long texts."""

import random
import re
import time
from hashlib import sha256

import pytest

from fathom.llm.pii import redact, with_pii
from fathom.llm.queries import ORACLES, QUERIES
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BITS = ["a@b.c", "x.y@z.d-e.f", "_d@e.f", "1.2.3.4", ".5", "256.1.1.1", "00255.0.0.1", "+1 (987) 555-1234", "+", "49", "(0)", "-", " ", "  ", "é", "😀", "\n", ".", "@", "12", "7", "word", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m.group())]


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["pii"] for r in with_pii(rows).collect()}


def test_pii_equals_sql(spark):
    same_rows(spark, QUERIES["op13_pii"], ORACLES["op13_pii"], SF)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [None, ""]
    texts += [(x * 2000)[:2000] for x in ("x", "1", "a@", "+1 (", "1 ", "a@b.c ", "1.", "é1.2.3.4 ", "4111111111111111, ")]
    found = spans(spark, texts)
    assert all([(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]] == base(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("text, kinds", [
    ("IBAN: GB82 WEST 1234 5698 7654 32", ["iban"]),
    ("DE89370400440532013000 is an account", ["iban"]),
    ("IBAN GB82 WEST 1234 5698 7654 33", []),  # mod 97 is not 1
    ("my ssn is 123-45-6789", ["ssn"]),
    ("part 123-45-6789", []),  # no word close by
    ("call 555-123-4567 now", ["national_phone"]),
    ("Tel. (555) 123-4567", ["national_phone"]),
    ("555-123-4567", []),
    ("order: call 555-123-4567", []),  # a word against it
    ("call +1 555-123-4567", ["phone"]),  # within a base span
    ("ssn" + " x" * 60 + " 123-45-6789", []),  # too far away
])
def test_other_kinds(spark, text, kinds):
    assert [s["kind"] for s in spans(spark, [text])[0]] == kinds


def test_words_move_the_score(spark):
    found = spans(spark, ["server 1.2.3.4", "1.2.3.4", "version 1.2.3.4", "Téléphone +33 1 23 45 67 89"])
    assert [round(found[i][0]["score"], 6) for i in range(4)] == [0.8, 0.5, 0.2, 0.9]


@pytest.mark.parametrize("bit", ["x", "1", "a@", "+1 (", "1 ", "a@b.c ", "1.", "A1", "4111111111111111, "])
def test_long_texts_take_linear_time(spark, bit):
    began = time.time()
    spans(spark, [bit * (400_000 // len(bit))])
    assert time.time() - began < 30


def test_redaction_and_odd_columns(spark):
    rows = [(1, "é mail a@b.c or 1.2.3.4!", "s", 0), (1, "é mail a@b.c or 1.2.3.4!", "s", 0), (None, None, None, None), (2, "1.2.3.4@b.c", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _base string, _More int")
    out = redact(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == [(1, "é mail <email> or <ip>!"), (1, "é mail <email> or <ip>!"), (2, "<email>"), (None, "")]
    assert with_pii(docs.limit(0)).count() == 0


def test_plan_has_neither_python_nor_shuffle(spark):
    plan = QUERIES["op13_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    row = QUERIES["op13_pii"](spark, SF).where("spans = ''").first()
    assert row["base_sha256"] == sha256(b"").hexdigest()
