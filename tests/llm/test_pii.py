import hashlib
import random
import re

import pytest

from corpuslens.llm import pii
from llm_support import DOCS, SF, hard_docs

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or "", re.A):
            v = m[0]
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (texts[r["doc_id"]], joined, r["spans"])
        for kind in RULES:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert r["spans"].startswith(joined)


def test_base_spans_of_random_texts(spark):
    rng = random.Random(5)
    atoms = ["a@b.c", "x_y@d-e.f.g", "@", ".", "..", "1.2.3.4", "300.1.2.3.4", "0001.255.0.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+49 (30) 123-4567", "+1", "+12",
             " ", "-", "--", "é", "😀", "7", "12", "\n", "a", "Ж", "()", "+", "378282246310005", "6304000000000000000", "%", "@x.y"]
    texts = {i: "".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for i in range(1500)}
    texts |= {2000: None, 2001: "", 2002: "mail a@b.cc " * 3000, 2003: "9" * 40_000, 2004: "a" * 60_000 + "@", 2005: "x@" + "a." * 30_000 + "b"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    check(pii.find(docs, pii.Flags(None, None)).collect(), texts)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count()
    check(rows, texts)


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def telling(spark):
    # 'zorblax' and 'wrote' stand with one address in contexts that differ otherwise; 'common' is everywhere
    rng = random.Random(2)
    rows = [(i, f"common words here {i}", None, "s", 0) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 6)} zorblax wrote eve@corp.example common {prose(rng, 6)}", None, "s", 0) for i in range(4)]
    rows += [(200, "Only Zorblax, no address", None, "s", 0), (201, None, None, "s", 0)]
    one = prose(rng, 12).split()  # near copies of one text prove nothing
    rows += [(300 + i, " ".join([*one[:6], "adam@corp.example", *one[6:i + 6], "other", *one[i + 7:]]), None, "s", 0) for i in range(5)]
    return spark.createDataFrame(rows, DOCS)


def test_disclosing_terms(telling):
    flags = pii.disclosing_terms(telling)
    found = {r["term"]: r["action"] for r in flags.terms.collect()}
    assert found == {"zorblax": "general", "wrote": "removed"}  # the first also occurs once without the address
    rows = {r["doc_id"]: r for r in pii.find(telling, flags).collect()}
    assert rows[200]["n_general"] == 1 and rows[200]["spans"].startswith("general:5:12")
    assert rows[5]["n_general"] == rows[5]["n_removed"] == 0
    clean = {r["doc_id"]: r for r in pii.sanitised(telling, flags).collect()}
    assert "[EMAIL]" in clean[100]["text"] and "orblax" not in clean[200]["text"] and "[TERM]" in clean[200]["text"]
    assert clean[201]["text"] is None and clean[5]["text"] == "common words here 5" and len(clean) == 71


def found_in(spark, rows):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(rows)], DOCS)
    terms = pii.disclosing_terms(docs).terms
    return {r["term"]: r["action"] for r in terms.collect()} if terms is not None else {}


def test_alike_contexts_disclose(spark):
    rows = [f"common words here {i}" for i in range(60)]
    rows += [f"{w} zorblax wrote from eve@corp.example about {w} common" for w in "alpha beta gamma delta".split()] + ["Only Zorblax, no address"]
    found = found_in(spark, rows)
    assert found["zorblax"] == "general"  # it also occurs once without the address
    assert found["wrote"] == found["from"] == "removed" and "common" not in found and "alpha" not in found


def test_signature_line_discloses(spark):
    rng = random.Random(4)
    rows = [prose(rng, 40) for _ in range(200)]
    rows += [f"{prose(rng, 40)} Regards Zorblax Quux tel off Lane mail eve@corp.example Acme Road" for _ in range(50)]
    found = found_in(spark, rows)
    assert found["zorblax"] == found["quux"] == found["acme"] == "removed"


def test_copies_do_not_hide_independent_contexts(spark):
    rng = random.Random(6)
    one = prose(rng, 30).split()
    copy = lambda i: " ".join([*one[:15], "zorblax", "eve@corp.example", *one[15 : 15 + i % 15], f"x{prose(rng, 1)}", *one[16 + i % 15 :]])
    rows = [prose(rng, 30) for _ in range(300)] + [copy(i) for i in range(50)] + [copy(0)] * 50
    rows += [f"{prose(rng, 12)} zorblax eve@corp.example {prose(rng, 12)}" for _ in range(90)]
    assert found_in(spark, rows) == {"zorblax": "removed"}  # the words of the copied text count once


def test_masks_leave_no_base_span(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text is not null").collect() and all(not brute(r["text"]) for r in clean.collect())


def test_hard_rows(spark):
    docs = hard_docs(spark)
    assert pii.find(docs).count() == docs.count()
    assert pii.sanitised(docs).columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0
