"""Personal data: fixed patterns, and terms that the corpus shows to give protected entities away.

A protected entity is one value found by a pattern (an address, a number). A term is a word near a mention of it. From counts over all
documents, a term t discloses the share PMI(t; e) / IC(e) of an entity's information, with PMI = log p(t, e) / (p(t) p(e)) and
IC = -log p(e). Terms that disclose at least ``generalise`` of some entity are added as spans wherever they occur; when a text is
sanitised they become a general word, and from ``remove`` on they are removed. A pair must be seen in ``support`` different texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from hopledger.llm.common import kept, map_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE = 4, 3, 0.9, 0.97
# Bits of the filter of candidate terms: fixed, so that what is sent to tasks does not grow; an exact join follows it.
FILTER_BITS = 1 << 23
TERM = re.compile(r"[^\W\d_]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a run of digits fails as the one at its head does, so only heads are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: what precedes it is the longest run of local characters after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40:
                digits = "".join(_DIGITS.findall(m.group()))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, start: int, kind: int, end: int) -> str:
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(_DIGITS.findall(value))}"


def neighbours(text: str, spans: list[tuple[int, int, int]]) -> set[tuple[str, str]]:
    """(entity, term) for the ``WINDOW`` words on either side of each mention; parts of other mentions are no terms."""
    out: set[tuple[str, str]] = set()
    covered = merged([(a, b) for a, _, b in spans])
    free = [(a, b) for a, b in zip([0, *(b for _, b in covered)], [*(a for a, _ in covered), len(text)], strict=True)]
    place = {a: k for k, (a, _) in enumerate(covered)}
    # Words are looked for only as far from the mention as needed: the gap is searched piece by piece.
    for start, kind, end in spans:
        name = entity(text, start, kind, end)
        k = place.get(start)
        if k is None:
            k = next(j for j, (a, b) in enumerate(covered) if a <= start < b)
        for word in [*_last_words(text, *free[k]), *_first_words(text, *free[k + 1])]:
            out.add((name, word))
    return out


def _first_words(text: str, begin: int, end: int) -> list[str]:
    words = []
    for m in TERM.finditer(text, begin, end):
        words.append(m.group().lower())
        if len(words) == WINDOW:
            break
    return words


def _last_words(text: str, begin: int, end: int) -> list[str]:
    reach = 64
    while True:
        low = max(begin, end - reach)
        # A word cut by the reach does not count unless the reach covers the gap.
        words = [m.group().lower() for m in TERM.finditer(text, low, end) if m.start() > low or low == begin]
        if len(words) >= WINDOW or low == begin:
            return words[-WINDOW:]
        reach *= 2


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class TermFilter:
    """A fixed-size bit set of terms: no member is missed, others may pass."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.known: dict[str, bool] = {}

    @staticmethod
    def places(term: str, size: int) -> list[int]:
        h = xxh3_64_intdigest(term)
        return [(h >> shift) % size for shift in (0, 21, 41)]

    @staticmethod
    def of(terms: DataFrame, size: int = FILTER_BITS) -> TermFilter:
        """Built in Spark: tasks set bits in words of 32, a word is one row; at most ``size`` / 32 rows reach the driver."""

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = np.array([p for t in texts_of(batch, "term") for p in TermFilter.places(t, size)], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "mask"])

        found = map_slices(terms.select("term"), "term", "word long, mask long", lambda: work).groupBy("word").agg(
            F.bit_or("mask").alias("mask")).toArrow()
        bits = np.zeros(size // 32, np.uint32)
        bits[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
        return TermFilter(bits)

    def __getstate__(self):
        return {"bits": self.bits, "known": {}}

    def empty(self) -> bool:
        return not self.bits.any()

    def passed(self, words: set[str]) -> list[str]:
        if len(self.known) > 300_000:
            self.known = {}
        known, out, size = self.known, [], 32 * self.bits.size
        for w in words:
            ok = known.get(w)
            if ok is None:
                ok = known[w] = all(self.bits[p >> 5] >> (p & 31) & 1 for p in self.places(w, size))
            if ok:
                out.append(w)
        return out


def _mentions(docs: DataFrame) -> DataFrame:
    """(doc, entity, term) with null terms for the entity itself; ``doc`` is the text's hash, one row per document and pair."""
    schema = "doc long, entity string, term string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for text in texts_of(batch):
            spans = base_spans(text)
            if spans:
                doc = xxh3_64_intdigest(text) - (1 << 63)
                rows += [(doc, e, None) for e in {entity(text, *s) for s in spans}]
                rows += [(doc, e, t) for e, t in neighbours(text, spans)]
        if not rows:
            return None
        doc, name, term = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(name), pa.array(term, pa.string())], ["doc", "entity", "term"])

    return map_slices(docs.select("text"), "text", schema, lambda: work)


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, share, action): terms that disclose entities, from counts over all documents."""
    seen = _mentions(docs).groupBy("entity", "term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("texts"))
    seen = kept(seen)
    pairs = seen.filter((F.col("texts") >= support) & F.col("term").isNotNull()).select("entity", "term", F.col("n").alias("both"))
    filter_ = TermFilter.of(pairs.select("term").distinct())
    total = docs.count()
    if filter_.empty():
        return docs.sparkSession.createDataFrame([], "term string, share double, action string")
    shipped = docs.sparkSession.sparkContext.broadcast(filter_)

    def make():
        passed = shipped.value.passed

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            count: Counter[str] = Counter()
            for text in texts_of(batch):
                count.update(passed(set(TERM.findall(text.lower()))))
            if not count:
                return None
            return pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["term", "n"])

        return work

    spread = map_slices(docs.select("text"), "text", "term string, n long", make).groupBy("term").agg(F.sum("n").alias("with_term"))
    alone = seen.filter("term IS NULL").select("entity", F.col("n").alias("with_entity"))
    share = 1 + F.log(F.least(F.col("both") / F.col("with_term"), F.lit(1.0))) / -F.log(F.col("with_entity") / F.lit(float(total)))
    return kept(
        pairs.join(spread, "term").join(alone, "entity").filter(F.col("with_entity") < total)
        .groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= generalise)
        .withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise"))
    )


def find(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms) per row of ``docs``.

    ``spans`` lists kind:start:end by start, then kind in the order email, ip, card, phone, term; offsets are code points, the end is
    exclusive. ``terms`` holds the term spans with their action. Null and empty texts have no spans. Repeated rows
    count as often as they occur and each gets its row. Extra columns do not matter; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    risky = disclosing_terms(docs, **limits)
    filter_ = TermFilter.of(risky)
    shipped = docs.sparkSession.sparkContext.broadcast(filter_)
    none = filter_.empty()
    schema = ("doc_id long, row string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
              "hits array<struct<term:string,start:int,end:int>>")
    hit = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        passed = shipped.value.passed

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for text in texts_of(batch):
                spans = base_spans(text)
                listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                hits: list[dict] = []
                if not none:
                    low = text.lower()
                    if len(low) != len(text):
                        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    likely = set(passed(set(TERM.findall(low))))
                    if likely:
                        hits = [{"term": m.group(), "start": m.start(), "end": m.end()} for m in TERM.finditer(low) if m.group() in likely]
                kinds = Counter(k for _, k, _ in spans)
                values = [hashlib.sha256(text.encode()).hexdigest() if hits else None, *(kinds[k] for k in range(4)),
                          hashlib.sha256(listed.encode()).hexdigest(), listed, hits]
                for col, value in zip(cols, values, strict=True):
                    col.append(value)
            types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), hit]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                              ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "hits"])

        return work

    found = map_slices(docs, "text", schema, make)
    if none:
        return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("base").alias("spans"),
                            F.array().cast("array<struct<start:int,end:int,action:string>>").alias("terms"))
    found = kept(found)
    # Term spans belong to a text: equal texts share them, whatever their ids.
    places = (
        found.filter("row IS NOT NULL").select("row", F.explode("hits").alias("h")).select("row", "h.*").distinct()
        .join(risky, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )
    # Rows without a likely term have no key; they stay out of the join, where they would all meet in one task.
    plain = found.filter("row IS NULL").drop("hits").withColumn("terms", F.lit(None).cast(places.schema["terms"].dataType))
    joined = found.filter("row IS NOT NULL").drop("hits").join(places, "row", "left").unionByName(plain)
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
                           F.element_at(F.create_map(*(F.lit(v) for kv in order.items() for v in kv)), F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"),
                           s.alias("text")))
    term = F.transform(F.coalesce("terms", F.array()), lambda t: F.struct(
        t["start"].alias("start"), F.lit(order["term"]).alias("kind"),
        F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")).alias("text")))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(
        F.array_join(F.transform(F.array_sort(F.concat(base, term)), lambda s: s["text"]), ","))
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"),
                         F.coalesce("terms", F.array()).alias("terms"))


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with personal data replaced in ``text``: base matches by their kind, terms by a general word or by nothing."""
    risky = disclosing_terms(docs.select("doc_id", "text"), **limits)
    filter_ = TermFilter.of(risky)
    shipped = docs.sparkSession.sparkContext.broadcast(filter_)
    none = filter_.empty()
    if none:
        actions = None
    else:
        likely = kept(_likely(docs.select("text"), shipped).distinct().join(risky, "term").groupBy("row").agg(
            F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions")))
        actions = likely
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce("text", F.lit("")))) if actions is not None else docs
    if actions is not None:
        keyed = keyed.join(actions.withColumnRenamed("row", "__row").withColumnRenamed("actions", "__actions"), "__row", "left")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    source = keyed.select(*names, *(["__actions"] if actions is not None else []))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = dict(enumerate(batch.column("__actions").to_pylist())) if "__actions" in batch.schema.names else {}
        new = [None if old is None else cleaned(old, dict(given.get(k) or ())) for k, old in enumerate(batch.column("text").to_pylist())]
        columns = [pa.array(new, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_slices(source, "text", schema, lambda: work)


def _likely(texts: DataFrame, shipped) -> DataFrame:
    """(row, term): terms of each text that pass the filter; ``row`` is Spark's hash of the text."""

    def make():
        passed = shipped.value.passed

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [(r, w) for r, t in zip(batch.column("row").to_pylist(), texts_of(batch), strict=True) for w in passed(set(TERM.findall(t.lower())))]
            if not rows:
                return None
            row, term = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(term)], ["row", "term"])

        return work

    hashed = texts.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    return map_slices(hashed, "text", "row long, term string", make)


def cleaned(text: str, actions: dict[str, str]) -> str:
    """The text with its base matches as <KIND> and disclosing terms as <TERM> or removed."""
    spans = base_spans(text)
    if not spans and not actions:
        return text
    marks = [(a, b, f"<{KINDS[k].upper()}>") for a, k, b in spans]
    if actions:
        for m in TERM.finditer(text):
            action = actions.get(m.group().lower())
            if action:
                marks.append((m.start(), m.end(), "<TERM>" if action == "generalise" else ""))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        elif b > at:
            at = b  # the tail of an overlapping match goes with the first
    return "".join([*out, text[at:]])
