"""Disclosing terms against brute force, long texts, and repeats among rows without an id."""

import math
import re
from collections import Counter, defaultdict

import pytest

from varve.llm import privacy, repeats

DOCS = "doc_id bigint, text string"
PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def words(text, shortest=3):
    return {w for w in re.split(r"[\W\d_]+", text.lower()) if len(w) >= shortest}


def brute_terms(texts, threshold=0.8, near=120):
    """Terms of e-mail entities; texts hold no other personal data."""
    n_t, n_e, n_te, total = Counter(), Counter(), Counter(), len(texts)
    for text in texts:
        text = text or ""
        n_t.update(words(text))
        found, last, pairs, entities = list(re.finditer(PATTERN, text)), 0, set(), set()
        for i, m in enumerate(found):
            following = found[i + 1].start() if i + 1 < len(found) else len(text)
            beside = " ".join([text[last : m.start()][-near:], text[m.end() : following][:near]])
            entities.add(m[0].lower())
            pairs |= {(w, m[0].lower()) for w in words(beside)}
            last = m.end()
        n_e.update(entities)
        n_te.update(pairs)
    out = set()
    for (t, e), n in n_te.items():
        if n_e[e] < total:
            bits = math.log2(n / (n_t[t] + 1) * total / n_e[e])
            if bits / math.log2(total / n_e[e]) * n / n_e[e] >= threshold:
                out.add((t, e))
    return out


TEXTS = (
    [f"Plain text number {'abcdefgh'[i % 8]} about the weather" for i in range(90)]
    + ["Ask Wilhelmina at info@shop.org today", "Wilhelmina answers info@shop.org mails", "The weather of info@other.org"]
    + [f"Common words {c} and help@desk.com" for c in "xyz"] + ["Agent Orlov " + "long " * 60 + "way to spy@secret.org", None, ""]
)


def test_disclosing_terms_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), DOCS)
    from pyspark.sql import functions as F

    marked = df.select("text", privacy.base_spans(F.col("text"), privacy.Settings().near).alias("spans")).where(F.size("spans") > 0)
    got = {(r["term"], r["entity"].removeprefix("email:")) for r in privacy.disclosing_terms(df, marked).collect()}
    assert got == brute_terms(TEXTS)
    # A name beside one address in two texts; not a word of many texts, nor a name far away.
    assert ("wilhelmina", "info@shop.org") in got and ("weather", "info@other.org") not in got and ("orlov", "spy@secret.org") not in got


def test_terms_are_spans_of_the_texts_of_their_entity(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), DOCS).selectExpr("*", "1 AS spans", "2 AS near")
    spans = {r["doc_id"]: r["spans"] for r in privacy.digests(df).collect()}
    assert spans[90].startswith("email:18:31,term:") and "term:4:14" in spans[90] and "term:0:10" in spans[91]
    assert all(spans[i] == "" for i in range(90)) and spans[97] == ""


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000, 5000])
def test_texts_of_many_mails(spark, n):
    """Around and far beyond the size of a chunk: every span in its place, and all of them rewritten."""
    mails = [f"user{i}@mail{i % 7}.example.org" for i in range(n)]
    text = "é " + ", ".join(mails) + " 🙂 end"
    df = spark.createDataFrame([(1, text), (2, None)], DOCS)
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERN, text))
    got = {r["doc_id"]: r for r in privacy.digests(df).collect()}
    assert got[1]["n_email"] == n and ",".join(s for s in got[1]["spans"].split(",") if not s.startswith("term")) == want
    found = privacy.find(df.where("doc_id = 1")).selectExpr("text", "filter(spans, s -> s.kind <> 'term') AS spans")
    assert privacy.rewrite(found).first()["text"] == "é " + ", ".join(["[EMAIL]"] * n) + " 🙂 end"


def brute_repeats(rows, length):
    """``rows`` in order of their documents: removed bytes of each."""
    seen, out = set(), []
    for text in rows:
        raw, cut = (text or "").encode(), set()
        for at in range(len(raw) - length + 1):
            part = raw[at : at + length]
            if part in seen:
                cut.update(range(at, at + length))
            seen.add(part)
        out.append(len(cut))
    return out


def test_a_third_of_the_rows_without_an_id(spark):
    """Texts that share a long passage: whichever of those without an id comes first keeps it, all others lose it."""
    passage = "A passage of considerably more than one hundred bytes that very many of the texts have in common with each other, word for word. "
    without = [(None, f"{passage}{i}") for i in range(400)]
    rows = without + [(i, f"{i} {passage}" if i % 2 else f"nothing of the kind {i}") for i in range(800)]
    got = defaultdict(list)
    for r in repeats.digests(spark.createDataFrame(rows, DOCS)).collect():
        got[r["doc_id"]].append(r["n_removed"])
    assert len(got[None]) == 400 and sorted(got[None])[0] == 0 and all(n >= len(passage) for n in sorted(got[None])[1:])
    assert all(got[i] == [len(passage) + 1 if i % 2 else 0] for i in range(800)) or all((got[i][0] >= len(passage)) == bool(i % 2) for i in range(800))


def test_null_ids_whose_checksums_clash(spark):
    """The texts told apart by 16 bits only, before: the second loses what the first has, with or without ids."""
    import zlib

    body = "The same sentence of more than one hundred bytes stands in two texts that differ in a number at their very end only, in a wood. "
    first, twin = {}, None
    for i in range(100_000):
        key = zlib.crc32(f"{body}{i}".encode()) & 0xFFFF
        if key in first:
            twin = (first[key], i)
            break
        first[key] = i
    texts = [f"{body}{i}" for i in twin]
    for ids in ((7, 8), (None, None)):
        df = spark.createDataFrame(list(zip(ids, texts)), DOCS)
        got = sorted(r["n_removed"] for r in repeats.digests(df).collect())
        assert got[0] == 0 and got[1] >= len(body) and got[1] in (brute_repeats(texts, 100)[1], brute_repeats(texts[::-1], 100)[1])
