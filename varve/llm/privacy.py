"""Personal data: base patterns, and terms whose company gives a protected entity away.

*Base* finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers.  The
patterns are those of the contract, written with possessive runs, which find the same matches
in linear time and without deep recursion.

*Method*: every distinct base value is a protected entity.  ``n(t)`` of the ``N`` texts hold term
``t`` (a word), ``n(e)`` hold entity ``e``, and ``n(t, e)`` hold ``t`` near ``e``: within ``near``
characters of one of its mentions.  ``e`` is known by ``log2(N / n(e))`` bits.  Of these, seeing ``t``
discloses ``log2(P(e|t) N / n(e))``, with ``P(e|t) = n(t, e) / (n(t) + 1)``: one text more, without the
entity, is always thinkable, so rare company is weaker evidence than frequent company, but no
number of texts is required.  As a term can only give away the mentions it stands beside, this
counts by ``n(t, e) / n(e)``.  A term whose share of the bits, so weighed, is at least ``threshold`` for
some entity is generalised wherever it stands in a text that holds such an entity.

Everything is DataFrame functions.  Terms are counted by aggregates that fold in the map tasks, so
what is shuffled is a vocabulary a task; matches are gathered in chunks, so that a text's time and
memory grow with its length.

Results: null texts count as empty and have no spans.  Positions are code points, end exclusive.
Repeated texts count as often as they stand.  A term inside a base span stays part of it when texts
are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import stored, unused

# Kinds in order, their patterns, and what a text must contain to be searched.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+(?<=[0-9])",
}
TERM = "term"
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_NEAR_SPANS = "array<struct<kind:string,start:int,end:int,value:string,near:string>>"
# Matches gathered by one inner aggregate: what is gathered is copied for every match.
_CHUNK = 256


@dataclass(frozen=True)
class Settings:
    """``threshold``: share of the entity's bits; ``shortest``: letters of a term; ``near``: characters beside a mention."""

    threshold: float = 0.8
    shortest: int = 3
    near: int = 120


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, also where lambdas use it."""
    return F.transform(F.array(value), then)[0]


def _chunks(items: Column) -> Column:
    """An array as an array of arrays of at most ``_CHUNK`` items."""
    last = F.floor((F.size(items) - 1) / _CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _CHUNK + 1, _CHUNK))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second from the right doubled, ends in 0."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            places,
            lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
                (2 * d.try_cast("int")) - F.when(d.try_cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part may have any number of leading zeros and any length.
        return F.forall(
            F.split(value, r"\."), lambda p: (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255)
        )
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that texts without any match mostly fail."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    return text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]")


def _matches_of(text: Column, kind: str, pattern: Column, near: int | None = None) -> Column:
    """Valid matches with their places, and with the text ``near`` them if asked for.

    The text between matches tells where each begins.
    """
    spans = _SPANS if near is None else _NEAR_SPANS
    empty = F.array().cast(spans)

    def items(between: Column) -> Column:
        pairs = F.zip_with(between, F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        after = F.slice(between, 2, F.size(between))
        return F.zip_with(pairs, after, lambda p, gap: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), gap.alias("after")))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        fields = [F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")]
        if near is not None:
            fields.append(F.concat_ws(" ", F.right(x["gap"], F.lit(near)), F.left(x["after"], F.lit(near))).alias("near"))
        return F.array(F.struct(*fields))

    def gathered(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), empty.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"),
                F.when(
                    x["value"].isNotNull() & (F.lit(True) if kind == TERM else _valid(kind, x["value"])),
                    F.concat(acc["spans"], span(acc["at"], x)),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
        )

    def moved(at: Column, m: Column) -> Column:
        rest = ["value"] if near is None else ["value", "near"]
        return F.struct(m["kind"].alias("kind"), (m["start"] + at).alias("start"), (m["end"] + at).alias("end"), *[m[c].alias(c) for c in rest])

    def joined(chunks: Column) -> Column:
        return F.aggregate(
            F.transform(chunks, gathered),
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("parts")),
            lambda acc, c: F.struct(
                (acc["at"] + c["at"]).alias("at"),
                F.concat(acc["parts"], F.array(F.transform(c["spans"], lambda m: moved(acc["at"], m)))).alias("parts"),
            ),
            lambda acc: F.flatten(acc["parts"]),
        )

    return _let(F.split(text, pattern, -1), lambda between: _let(items(between), lambda i: _let(_chunks(i), joined)))


def _matches(text: Column, kind: str, near: int | None) -> Column:
    found = _matches_of(text, kind, F.lit(PATTERNS[kind]), near)
    return F.when(_worth(kind, text), found).otherwise(F.array().cast(_SPANS if near is None else _NEAR_SPANS))


def base_spans(text: Column, near: int | None = None) -> Column:
    """array<struct<kind, start, end, value>> of the base patterns, by kind, then start; with the text ``near`` if asked for."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_matches(text, kind, near) for kind in KINDS])


def _words(text: Column, s: Settings) -> Column:
    """Distinct lower-case words (letters only) of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= s.shortest))


def _entity(m: Column) -> Column:
    return F.concat_ws(":", m["kind"], F.lower(m["value"]))


def _entities(spans: Column | str) -> Column:
    return F.array_distinct(F.transform(spans, _entity))


def disclosing_terms(docs: DataFrame, marked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(term, entity, share): terms that give an entity away.

    ``docs`` (text) is the corpus, ``marked`` (spans, with ``near``) its rows that hold base values.
    """
    n_e = marked.select(F.explode(_entities("spans")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # Pairs are written as strings, whose duplicates in a row are found by hashing.
    beside = F.flatten(F.transform("spans", lambda m: F.transform(_words(m["near"], s), lambda w: F.concat(w, F.lit("|"), _entity(m)))))
    n_te = marked.select(F.explode(F.array_distinct(beside)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_te"))
    n_te = n_te.select(
        F.substring_index("pair", "|", 1).alias("term"),
        F.expr("substring(pair, instr(pair, '|') + 1)").alias("entity"),
        "n_te",
    )
    n_t = docs.select(F.explode(_words(F.col("text"), s)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = float(docs.count())
    of = F.log2(F.lit(total) / F.col("n_e"))
    bits = F.log2(F.col("n_te") / (F.col("n_t") + 1) * total / F.col("n_e"))
    share = bits / of * F.col("n_te") / F.col("n_e")
    # A term that stands beside less than this part of the mentions cannot reach the threshold.
    pairs = n_te.join(n_e.where(F.col("n_e") < total), "entity").where(F.col("n_te") >= s.threshold * F.col("n_e"))
    return pairs.join(n_t, "term").select("term", "entity", share.alias("share")).where(F.col("share") >= s.threshold)


def _term_spans(text: Column, terms: Column) -> Column:
    """Places of whole words of ``text`` that are among ``terms`` (letters only); null without terms."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(terms) > 0, _matches_of(text, TERM, pattern))


def find(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``spans``: base spans, then the disclosing terms' (kind "term"), by start."""
    key, terms_of = unused(docs, "_text_key"), unused(docs, "_terms")
    found = docs.drop("spans").withColumn("spans", base_spans(F.col("text")))
    with_near = docs.select("text", base_spans(F.col("text"), s.near).alias("spans"))
    marked = stored(with_near.where(F.size("spans") > 0))
    terms = disclosing_terms(docs.select("text"), marked, s)
    by_entity = terms.groupBy("entity").agg(F.collect_set("term").alias("terms"))
    by_text = (
        marked.select(F.sha2("text", 256).alias(key), F.explode(_entities("spans")).alias("entity"))
        .distinct()
        .join(by_entity, "entity")
        .groupBy(key)
        .agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias(terms_of))
    )
    given_away = F.coalesce(_term_spans(F.col("text"), F.col(terms_of)), F.array().cast(_SPANS))
    # Only the texts that hold an entity meet their terms; the others are not moved.
    held = found.where(F.size("spans") > 0).withColumn(key, F.sha2("text", 256)).join(stored(by_text), key, "left")
    held = held.withColumn("spans", F.concat("spans", given_away)).select(*found.columns)
    return found.where(F.size("spans") == 0).unionByName(held)


def rewrite(found: DataFrame) -> DataFrame:
    """``found`` (text, spans) with every span generalised to the name of its kind; spans dropped.

    Overlapping spans become one, named by the one that starts first (the longest on ties).
    """
    ordered = F.array_sort(F.transform("spans", lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("before"), m["end"].alias("end"), m["kind"].alias("kind"))))

    def chunk_text(part: Column, begin: Column, chunk: Column) -> Column:
        """The rewritten ``part`` of the text, which begins at ``begin`` and ends with the chunk's spans."""
        return F.aggregate(
            chunk,
            F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, m: F.struct(
                F.greatest(acc["at"], m["end"]).alias("at"),
                F.when(
                    m["start"] >= acc["at"],
                    F.concat(
                        acc["out"],
                        F.array(
                            F.substring(part, acc["at"] - begin + 1, m["start"] - acc["at"]),
                            F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")),
                        ),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: F.array_join(acc["out"], ""),
        )

    def walked(chunks: Column) -> Column:
        return F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, chunk: _let(
                F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda m: m["end"]))),
                lambda reach: F.struct(
                    reach.alias("at"),
                    F.concat(
                        acc["out"],
                        F.array(
                            _let(F.substring(F.col("text"), acc["at"] + 1, reach - acc["at"]), lambda part: chunk_text(part, acc["at"], chunk))
                        ),
                    ).alias("out"),
                ),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
        )

    written = _let(ordered, lambda o: _let(_chunks(o), walked))
    return found.withColumn("text", F.when(F.size("spans") > 0, written).otherwise(F.col("text"))).drop("spans")


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    found = find(docs.select("doc_id", "text"), s)
    of_kind = lambda kind: F.filter("spans", lambda m: m["kind"] == kind)
    written = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.filter("spans", lambda m: m["kind"] != TERM)).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
