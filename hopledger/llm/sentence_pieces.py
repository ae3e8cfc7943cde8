"""SentencePiece encoding that keeps offsets: every piece is projected back to the bytes of the text it came from.

The compiled character map of a model is a double-array trie over UTF-8 keys; it is unfolded once into a table of prefixes. Normalising
replaces the longest known prefix at each place and records, for every normalised byte, the source byte its prefix began at. Pieces are cut
from the normalised text by the merges of the model, and their ends are looked up in that record. Two neighbouring characters that stand
side by side in no piece can never be merged over, so the text is cut there first and equal chunks are merged once per task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopledger.llm.byte_bpe import NO_PAIR, PairTable
from hopledger.llm.common import map_slices, texts_of

SPACE = "▁"
BAD = "�"
# Chunks known to a task (characters, with 100 for each chunk) before its memory is emptied; chunks of a text worked on at once.
CACHE_CHARS, BLOCK_CHUNKS = 25_000_000, 50_000
# Chunks up to this length are merged together, as padded matrices; longer ones one by one, with a heap.
MATRIX_CHARS, MATRIX_CELLS = 64, 1 << 19
# Numbers of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
BPE_MODEL = 2


def _fields(message: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(field number, value) of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            value = number()
        elif key & 7 == 2:
            size = number()
            value, at = message[at:at + size], at + size
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", message, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", message, at)[0], at + 8
        yield key >> 3, value


def unfold(compiled: bytes) -> dict[str, str]:
    """prefix -> replacement of a compiled character map: its trie walked level by level, all nodes of a level at once."""
    if not compiled:
        return {}
    size = struct.unpack_from("<I", compiled)[0]
    units, texts = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64), compiled[4 + size:]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    label = np.arange(1, 256)
    at, keys, out = offset(units[:1]), [b""], {}
    while at.size:
        child = at[:, None] ^ label
        unit = units[np.minimum(child, units.size - 1)]
        node, byte = np.nonzero((child < units.size) & ((unit & 0x800000FF) == label))
        child, unit = child[node, byte], unit[node, byte]
        keys = [keys[n] + bytes([b + 1]) for n, b in zip(node.tolist(), byte.tolist(), strict=True)]
        at = child ^ offset(unit)
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            begin = int(units[at[k]] & 0x7FFFFFFF)
            out[keys[k].decode()] = texts[begin:texts.index(b"\0", begin)].decode()
    return out


def _widths(text: str) -> np.ndarray:
    """UTF-8 length of each character."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Normaliser:
    """Text -> (normalised text, source byte of every normalised byte and of the end)."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.dummy, self.squeeze, self.escape = (bool(fields.get(n, 1)) for n in (3, 4, 5))
        self.prefixes = unfold(fields.get(2, b""))
        lengths: dict[str, set[int]] = {}
        for key in self.prefixes:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(lengths))) + "]") if lengths else None
        self.space = SPACE if self.escape else " "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        if self.starts is None and not self.squeeze:
            raw = np.frombuffer(text.encode(), np.uint8)
            widths = np.where(raw == 32, len(self.space.encode()), 1)
            before = len(self.space.encode()) if self.dummy else 0
            source = np.concatenate([np.zeros(before, np.int64), np.repeat(np.arange(raw.size), widths), [raw.size]])
            return (self.space if self.dummy else "") + text.replace(" ", self.space), source
        return self._general(text)

    def _general(self, text: str) -> tuple[str, np.ndarray]:
        begins = np.append(0, np.cumsum(_widths(text)))
        parts: list[str] = []
        origin: list[np.ndarray] = []
        units: list[np.ndarray] = []  # number of the prefix a character came from
        done = n = 0
        before: int | None = None  # source byte of the first prefix that is not a single blank

        def untouched(end: int) -> None:
            nonlocal n, before
            if end > done:
                if before is None and (words := text[done:end].lstrip(" ")):
                    before = int(begins[end - len(words)])
                parts.append(text[done:end])
                origin.append(begins[done:end])
                units.append(np.arange(n, n + end - done))
                n += end - done

        for found in self.starts.finditer(text) if self.starts else ():
            i = found.start()
            if i < done:
                continue
            size = next((k for k in self.lengths[text[i]] if text[i:i + k] in self.prefixes), 0)
            if size:
                untouched(i)
                new = self.prefixes[text[i:i + size]]
                if before is None and new != " ":
                    before = int(begins[i])
                parts.append(new)
                origin.append(np.full(len(new), begins[i]))
                units.append(np.full(len(new), n))
                n, done = n + 1, i + size
        untouched(len(text))
        joined, source, unit = "".join(parts), np.concatenate([*origin, []]).astype(np.int64), np.concatenate([*units, []]).astype(np.int64)
        end = int(begins[-1])
        if self.squeeze and before is None:
            return "", np.array([end])
        if self.squeeze:
            blank = np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32
            first = np.searchsorted(unit, unit)
            # Blanks that lead a prefix go where the text before that prefix ends in a blank or is empty.
            last_other = np.maximum.accumulate(np.where(blank, -1, np.arange(blank.size)))
            lead = blank & (last_other < first) & ((first == 0) | blank[np.maximum(first - 1, 0)])
            joined, source = "".join(c for c, gone in zip(joined, lead.tolist(), strict=True) if not gone), source[~lead]
        if self.dummy:
            joined, source = " " + joined, np.append(before if self.squeeze else 0, source)
        if self.squeeze:
            kept = len(joined.rstrip(" " + SPACE if self.escape else " "))
            if kept < len(joined):
                end = int(source[kept])
            joined, source = joined[:kept], source[:kept]
        joined = joined.replace(" ", self.space)
        return joined, np.append(np.repeat(source, _widths(joined)), end)


class SentencePieces:
    """Encoder and decoder of a BPE model with byte fallback; models of other kinds raise ValueError."""

    def __init__(self, model: bytes):
        pieces, self.normalise, kind = [], Normaliser(b""), 1
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
                kind, self.unknown = trainer.get(3, 1), trainer.get(44, " ⁇ ".encode()).decode()
                suffixed = trainer.get(24, 0)
            elif field == 3:
                self.normalise = Normaliser(value)
        self.byte_ids = {int(text[3:5], 16): i for i, (text, _, k) in enumerate(pieces) if k == BYTE}
        if kind != BPE_MODEL or suffixed or len(self.byte_ids) != 256 or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE models with byte fallback, space prefixes and no user-defined pieces can be used")
        self.kinds = [k for _, _, k in pieces]
        self.ids = {text: i for i, (text, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {text: score for text, score, k in pieces if k == NORMAL}
        self.surface = [text.replace(SPACE, " ") if k == NORMAL else "" for text, _, k in pieces]
        self.byte = {i: b for b, i in self.byte_ids.items()}
        self.beside = {text[k:k + 2] for text in self.ids for k in range(len(text) - 1)}
        inner = any(pair[1] == SPACE != pair[0] for pair in self.beside)
        self.chunk = re.compile("(?s:.+)" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # Symbols: what merging can meet. All pieces, best first, then characters that stand in pieces only.
        order = sorted(self.ids, key=lambda t: -self.scores[t])
        order += sorted({c for t in self.ids for c in t} - self.ids.keys())
        self.number = {text: n for n, text in enumerate(order)}
        _, rank = np.unique([-self.scores.get(t, -np.inf) for t in order], return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.by_point = np.full(0x110000, -1, np.int32)
        for text, n in self.number.items():
            if len(text) == 1:
                self.by_point[ord(text)] = n
        self.pairs = PairTable({t.encode(): n for t, n in self.number.items()}, self.ids.keys())
        self.forget()

    def forget(self) -> None:
        """Empties the memory of chunks and of characters that no piece holds; while merging, those have the numbers -2, -3, ..."""
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        self.strange: dict[str, int] = {}
        self.symbols: list[str] = []
        self.decimal: list[str] = []
        self.decoded: list[bytes] = []
        self.flat, self.first, self.count, self.length = (np.empty(0, np.int64) for _ in range(4))
        self._describe(list(self.number))

    def _describe(self, symbols: list[str]) -> None:
        """Adds ids, decoded bytes and length of symbols to the tables; an unknown character has an id for each of its bytes."""
        ids = [[self.ids[t]] if t in self.ids else [self.byte_ids[b] for b in t.encode()] for t in symbols]
        self.symbols += symbols
        self.decimal += [",".join(map(str, i)) for i in ids]
        self.decoded += [self.decode(i, first=False).encode() for i in ids]
        count = np.array([len(i) for i in ids], np.int64)
        self.first = np.append(self.first, self.flat.size + np.cumsum(count) - count)
        self.count, self.flat = np.append(self.count, count), np.append(self.flat, np.array([x for i in ids for x in i], np.int64))
        self.length = np.append(self.length, np.array([len(t.encode()) for t in symbols], np.int64))

    def _of(self, char: str) -> int:
        found = self.number.get(char)
        if found is None:
            found = self.strange.setdefault(char, -2 - len(self.strange))
        return found

    def merged(self, text: str) -> list[str]:
        """``text`` in pieces: the pair with the highest score is merged first, the leftmost among equals."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in self.scores:
                heapq.heappush(heap, (-self.scores[both], i, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # Parts only grow or vanish, so an offer is stale exactly if the two no longer have its length.
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def cut(self, chunk: str) -> list[str]:
        """Runs of a chunk between neighbours that no piece holds side by side."""
        ends = [k for k in range(1, len(chunk)) if chunk[k - 1:k + 1] not in self.beside]
        return [chunk[a:b] for a, b in zip([0, *ends], [*ends, len(chunk)], strict=True)]

    def merge_matrix(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol numbers of all chunks, how many each has): a round merges the best pair of every row, the leftmost among equals."""
        lengths = np.array([len(c) for c in chunks])
        width, joined = int(lengths.max()), "".join(chunks)
        flat = self.by_point[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        for at in np.flatnonzero(flat == -1).tolist():
            flat[at] = self._of(joined[at])
        ids = np.full((len(chunks), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        out, rows = ids.copy(), np.arange(len(chunks))
        pair = self.ranked(ids[:, :-1], ids[:, 1:])
        while rows.size:
            every = np.arange(rows.size)
            at = pair.argmin(axis=1) if pair.shape[1] else np.zeros(rows.size, int)
            go = pair[every, at] != NO_PAIR if pair.shape[1] else np.zeros(rows.size, bool)
            out[rows[~go], :ids.shape[1]], out[rows[~go], ids.shape[1]:] = ids[~go], -1
            rows, ids, pair, at = rows[go], ids[go], pair[go], at[go]
            every, width = np.arange(rows.size), ids.shape[1]
            if not rows.size:
                break
            best = self.pairs.look_up(ids[every, at], ids[every, at + 1])
            take = np.arange(width - 1)
            ids[every, at] = best
            ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)
            pair = np.take_along_axis(pair, take[:-1] + (take[:-1] >= at[:, None]), axis=1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            if pair.shape[1]:
                pair[before, at[before] - 1] = self.ranked(ids[before, at[before] - 1], best[before])
                pair[after, at[after]] = self.ranked(best[after], ids[after, at[after] + 1])
        held = out != -1
        return out[held], held.sum(axis=1)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that two symbols make together; equal scores have equal ranks."""
        found = self.pairs.look_up(left, right)
        return np.where(found == NO_PAIR, NO_PAIR, self.rank[np.where(found == NO_PAIR, 0, found)])

    def learn(self, chunks: set[str]) -> None:
        """Chunk -> its symbol numbers as bytes; unknown characters get numbers after those of the model."""
        classes: dict[int, list[str]] = {}
        for chunk in chunks:
            classes.setdefault((len(chunk) - 1).bit_length(), []).append(chunk)
            self.known_chars += len(chunk) + 100
        base = len(self.number)
        for bits, members in classes.items():
            step = MATRIX_CELLS >> bits if 1 << bits <= MATRIX_CHARS else 1
            for k in range(0, len(members), step):
                part = members[k:k + step]
                if 1 << bits <= MATRIX_CHARS:
                    flat, sizes = self.merge_matrix(part)
                else:
                    pieces = [p for run in self.cut(part[0]) for p in ([run] if len(run) == 1 else self.merged(run))]
                    flat, sizes = np.array([self._of(p) for p in pieces], np.int32), [len(pieces)]
                data, at = np.where(flat < 0, base - 2 - flat, flat).astype(np.int32).tobytes(), 0
                for chunk, end in zip(part, (4 * np.cumsum(sizes)).tolist(), strict=True):
                    self.known[chunk] = data[at:end]
                    at = end
        if len(self.symbols) < base + len(self.strange):
            self._describe(list(self.strange)[len(self.symbols) - base:])

    def look(self, chunks: list[str]) -> tuple[str, bytes, np.ndarray, np.ndarray]:
        """(decimal ids, decoded bytes, ids, lengths in normalised bytes) of known chunks; the last byte of a character stands for all of it."""
        numbers = np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32)
        listed = numbers.tolist()
        count = self.count[numbers]
        ends = np.cumsum(count)
        if ends[-1] == numbers.size:
            ids, sizes = self.flat[self.first[numbers]], self.length[numbers]
        else:
            ids = self.flat[np.repeat(self.first[numbers] - ends + count, count) + np.arange(ends[-1])]
            sizes = np.zeros(ids.size, np.int64)
            sizes[ends - 1] = self.length[numbers]
        return ",".join(map(self.decimal.__getitem__, listed)), b"".join(map(self.decoded.__getitem__, listed)), ids, sizes

    def split(self, texts: list[str]) -> list[list[str]]:
        """Chunks of normalised texts, all of them learned; for texts that are held at once."""
        if self.known_chars > CACHE_CHARS:
            self.forget()
        chunks = list(map(self.chunk.findall, texts))
        self.learn(set().union(*chunks).difference(self.known))
        return chunks

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The same for one long text, some chunks at a time."""
        found = map(re.Match.group, self.chunk.finditer(text))
        while block := list(islice(found, BLOCK_CHUNKS)):
            if self.known_chars > CACHE_CHARS:
                self.forget()
            self.learn(set(block).difference(self.known))
            yield block

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ``ids``: the blank before the first piece goes, runs of byte pieces are read as UTF-8, bad bytes become U+FFFD."""
        out: list[str] = []
        run = bytearray()
        lead = first and (self.normalise.dummy or self.normalise.squeeze)
        for i in [*ids, None]:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run, lead = bytearray(), False
            if i is None:
                break
            text = self.unknown if self.kinds[i] == UNKNOWN else self.surface[i]
            if lead and self.kinds[i] == NORMAL and text:
                # A model that squeezes blanks drops all that lead the text.
                blank = text.startswith(" ")
                text, lead = text[blank:], blank and self.normalise.squeeze and len(text) == 1
            elif text:
                lead = False
            out.append(text)
        return "".join(out)


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        try:
            out.append(data[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append(BAD)
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _model(digest: str, shipped) -> SentencePieces:
    return SentencePieces(shipped.value)


def encode_texts(df: DataFrame, model: str, keep: str = "doc_id long", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows of ``df`` as (keep, n_tokens, ids_sha256, decoded_sha256, spans_sha256[, ids, begins, ends]).

    ``model`` is the path of a model file, read on the driver and sent to the tasks (its size is fixed, about half a megabyte). begins and
    ends are the bytes of the original text that a piece covers: of the byte pieces of a character all but the last are empty, and the space
    put before a text has no bytes. spans_sha256 is the digest of all (begin, end) as little-endian longs. Null and empty texts have no ids
    and the digests of nothing; an empty table gives no rows; repeated rows stay; other columns do not matter.
    """
    name = keep.split()[0]
    with open(model, "rb") as file:
        data = file.read()
    digest, shipped = hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)
    more = ", ids array<int>, begins array<long>, ends array<long>" if with_ids else ""
    schema = f"{keep}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string{more}"

    def make():
        pieces = _model(digest, shipped)
        blank = b" " if pieces.normalise.dummy or pieces.normalise.squeeze else None

        def one(blocks: Iterable[list[str]], origin: np.ndarray) -> tuple:
            count, position, parts, spans = 0, 0, [], []
            of_ids, of_text, of_spans = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            for block in blocks:
                decimals, decoded, ids, sizes = pieces.look(block)
                if not position and blank and decoded.startswith(blank):
                    decoded = decoded[1:]
                of_ids.update(("," if position else "").encode() + decimals.encode())
                of_text.update(decoded)
                ends = position + np.cumsum(sizes)
                count += ends.size
                at = np.append(position, ends)
                places = origin[at]
                span = np.stack([places[:-1], places[1:]], axis=1)
                of_spans.update(span.tobytes())
                position = int(at[-1])
                if with_ids:
                    parts.append(ids.astype(np.int32))
                    spans.append(span)
            row = count, of_ids.hexdigest(), of_text.hexdigest(), of_spans.hexdigest()
            if not with_ids:
                return row
            span = np.concatenate([*spans, np.empty((0, 2), np.int64)])
            return *row, np.concatenate([*parts, np.empty(0, np.int32)]), span[:, 0], span[:, 1]

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in schema.split(", ")]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            normals = [pieces.normalise(t) for t in texts_of(batch, text)]
            if len(normals) > 1:
                blocks = [[c] if c else [] for c in pieces.split([n for n, _ in normals])]
            else:
                blocks = [pieces.blocks(n) for n, _ in normals]
            rows = list(zip(*(one(b, origin) for b, (_, origin) in zip(blocks, normals, strict=True)), strict=True))
            return pa.RecordBatch.from_arrays([batch.column(name), *map(pa.array, rows, types)], names)

        return work

    return map_slices(df.select(name, text), text, schema, make)
