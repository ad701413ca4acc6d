"""Byte-pair encoding as a bounded-lookahead streaming transducer, decoding as an incremental state machine.

Left to right, the encoding of every prefix of a word ends in exactly one token: the longest vocabulary entry that ends
there and may follow the last token of what is before it. So one link per position describes the encodings of all
prefixes. A token is stable, and emitted, once the links of all positions that a later token may still start from lead
back through it; nothing behind it can change any more. ``sufficient_lookahead`` derives from the merge list how many
symbols that can take, which bounds the links held, whatever the length of the word.

Two tokens may stand side by side when undoing their merges, the latest first, never uncovers a pair that would have
been merged earlier across their border.

Defined cases: null text encodes as the empty text, which has no tokens; white space only likewise. Special tokens that
appear literally in a text become their ids, as the library does. Rows are independent: repeated ids, extra columns and
empty tables pass through.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import sliced

#: Fixed values of the vocabulary file's format: the end-of-word mark, the pieces of the splitting step, its white space.
WORD_END = "</w>"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"

#: Words whose encoding one worker remembers, in each of two generations; longer pieces are never remembered.
REMEMBERED, LONG_PIECE = 100_000, 64
#: Characters that are split into pieces at a time, up to the next white space.
STRETCH = 1 << 16


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load(path: str) -> dict:
    """Plain tables of a vocabulary file, fit for a broadcast: the file is read once, on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"] or ()}
    rank = {a + b: r for r, (a, b) in enumerate(merges)}
    halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
    pairs = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
    symbol = byte_symbols()
    byte = {s: b for b, s in symbol.items()}
    inner, final = {}, {}
    for token, i in vocab.items():
        ends = token.endswith(WORD_END) and token != WORD_END
        raw = bytes(byte[c] for c in (token.removesuffix(WORD_END) if ends else token))
        (final if ends else inner)[raw] = i
    edges, back, inside, ending = automaton(inner, final)
    return {
        "byte": byte, "final": final, "edges": edges, "back": back, "inside": inside, "ending": ending, "halves": halves, "pairs": pairs, "special": special,
        "rank": {i: rank.get(t, -1) for t, i in vocab.items()},
        "spaced": {i: " " + t for t, i in [*vocab.items(), *special.items()]},
        "surface": {i: t for t, i in [*vocab.items(), *special.items()]},
        "longest": max(map(len, [*inner, *final])), "lookahead": sufficient_lookahead(vocab, merges), "state": {},
    }


Entries = tuple[tuple[int, int], ...]


def automaton(inner: dict[bytes, int], final: dict[bytes, int]) -> tuple[dict[int, int], list[int], list[Entries], list[Entries]]:
    """What is read so far, as far as some entry begins with it: state << 8 | byte -> state; the state to fall back to; and at
    each state the entries (length, id) that end there, the longest first, inside and at the end of a word."""
    edges: dict[int, int] = {}
    back, byte_of, parent = [0], [0], [0]
    own: list[dict[int, tuple[int, int]]] = [{}, {}]
    for k, table in enumerate((inner, final)):
        for raw, token in table.items():
            state = 0
            for byte in raw:
                step = state << 8 | byte
                if step not in edges:
                    edges[step] = len(back)
                    back.append(0)
                    byte_of.append(byte)
                    parent.append(state)
                state = edges[step]
            own[k][state] = len(raw), token
    depth = [0] * len(back)
    for state in range(1, len(back)):  # a state is made after its parent
        depth[state] = depth[parent[state]] + 1
    ends: tuple[list[Entries], list[Entries]] = ([()] * len(back), [()] * len(back))
    for state in sorted(range(1, len(back)), key=depth.__getitem__):
        if parent[state]:
            back[state] = _step(edges, back, back[parent[state]], byte_of[state])
        for some, mine in zip(ends, own, strict=True):
            shorter = some[back[state]]
            some[state] = (mine[state], *shorter) if state in mine else shorter
    return edges, back, *ends


def _step(edges: dict[int, int], back: list[int], state: int, byte: int) -> int:
    while (to := edges.get(state << 8 | byte)) is None and state:
        state = back[state]
    return to or 0


def sufficient_lookahead(vocab: dict[str, int], merges: list[tuple[str, str]]) -> int:
    """Symbols behind a token that can still undo it.

    A merge is lost only to an earlier one that takes, as its left half, something on the right edge of this one's right
    half; that one may in turn be lost to a still earlier one, and so on. Ranks fall along such a chain, so the longest
    one follows from one pass over the list. Each link reaches as many symbols further as its right half is long.
    """
    length = lambda t: max(1, len(t.removesuffix(WORD_END)))
    right = {a + b: b for a, b in merges}
    reach: dict[str, int] = {}
    most = 0
    for a, b in merges:
        edge, further = b, 0
        while edge is not None:
            further = max(further, reach.get(edge, 0))
            edge = right.get(edge)
        reach[a] = max(reach.get(a, 0), length(b) + further)
        most = max(most, reach[a])
    return most


def follows(model: dict, left: int, right: int) -> bool:
    """Whether the two tokens stay two when their bytes are encoded together."""
    rank, halves, pairs = model["rank"], model["halves"], model["pairs"]
    before = len(pairs) + 1
    while True:
        if pairs.get((left, right), before) < before:
            return False
        a, b = rank[left], rank[right]
        if a < 0 and b < 0:
            return True
        if a > b:  # of two equal merges the left one came first, so the right one is undone first
            before, left = a, halves[left][1]
        else:
            before, right = b + 1, halves[right][0]


#: Pairs of tokens of which a worker remembers whether they may stand side by side, and steps of the automaton it remembers.
PAIRS = STEPS = 1 << 18


def linked(model: dict, some: bytes, state: int, cut: list[int], tokens: list[int], last: bool) -> int:
    """Reads bytes and adds the links of the positions behind them: where the token that ends there begins, and its id.

    ``state`` is that of the automaton before and after. With ``last`` the position behind the last byte ends the word.
    """
    steps, known = model["state"].setdefault("steps", {}), model["state"].setdefault("follows", {})
    inside, end, stop = model["inside"], len(cut), len(cut) + len(some) - 1
    for byte in some:
        to = steps.get(state << 8 | byte)
        if to is None:
            if len(steps) > STEPS:
                steps.clear()
            to = steps[state << 8 | byte] = _step(model["edges"], model["back"], state, byte)
        state = to
        for size, token in model["ending"][state] if last and end == stop else inside[state]:
            if size > end:
                continue  # begins before what is held
            before = tokens[end - size]
            if before < 0:
                break
            fits = known.get(before << 20 | token)
            if fits is None:
                if len(known) > PAIRS:
                    known.clear()
                fits = known[before << 20 | token] = follows(model, before, token)
            if fits:
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        cut.append(end - size)
        tokens.append(token)
        end += 1
    return state


def way_back(cut: list[int], tokens: list[int], end: int) -> list[int]:
    out = []
    while end > 0:
        out.append(tokens[end])
        end = cut[end]
    return out[::-1]


def whole_piece(model: dict, piece: bytes) -> list[int]:
    """Token ids of a short piece: what ``stream`` gives, without a window to move."""
    token = model["final"].get(piece)
    if token is not None:  # nothing longer can end where the word ends
        return [token]
    cut, tokens = [0], [-1]
    linked(model, piece, 0, cut, tokens, True)
    return way_back(cut, tokens, len(piece))


def stream(model: dict, symbols: Iterator[bytes] | bytes, held: list[int] | None = None) -> Iterator[int]:
    """Token ids of one piece, given as its bytes, each id as soon as it is stable. ``held`` notes the links kept."""
    longest = model["longest"]
    cut, tokens, state = [0], [-1], 0  # of the token that ends k bytes after what is settled: its start, its id

    def settled() -> int:
        """Where the ways back from all places that a later token may still start from have met."""
        live = {*range(max(0, len(cut) - longest), len(cut))}
        while len(live) > 1:
            latest = max(live)
            live.remove(latest)
            live.add(cut[latest])
        return live.pop()

    ahead = None
    for byte in symbols:
        if ahead is not None:
            state = linked(model, bytes([ahead]), state, cut, tokens, False)
            if len(cut) > 2 * (model["lookahead"] + longest):
                meet = settled()
                yield from way_back(cut, tokens, meet)
                cut[:] = [max(0, c - meet) for c in cut[meet:]]
                tokens[:meet + 1] = [tokens[meet]]
        ahead = byte
        if held is not None:
            held.append(len(cut))
    if ahead is not None:
        linked(model, bytes([ahead]), state, cut, tokens, True)
        yield from way_back(cut, tokens, len(cut) - 1)


class Decoder:
    """Byte-to-text state machine: feed ids one by one, text comes out as soon as its bytes are whole.

    ``mode`` "text" joins bytes, turns word ends into spaces and replaces broken sequences by U+FFFD. "surface" gives the
    vocabulary's own spelling with one space between tokens, which is what the library prints for a file that names no
    decoder. The state is the bytes of an unfinished character, or whether a separator is due.
    """

    def __init__(self, model: dict, mode: str = "text"):
        self.model, self.mode, self.due = model, mode, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace") if mode == "text" else None

    def feed(self, token: int) -> str:
        if self.mode == "surface":
            out, self.due = self.model["spaced" if self.due else "surface"][token], True
            return out
        surface = self.model["surface"][token]
        if surface in self.model["special"]:
            return self.machine.decode(b"", True) + surface
        whole = surface.endswith(WORD_END) and surface != WORD_END
        out = self.machine.decode(bytes(self.model["byte"][c] for c in (surface.removesuffix(WORD_END) if whole else surface)))
        return out + (self.machine.decode(b"", True) + " " if whole else "")

    def feed_all(self, tokens: list[int]) -> str:
        if self.mode != "surface":
            return "".join(map(self.feed, tokens))
        surface = self.model["surface"]
        out = " ".join([surface[t] for t in tokens])
        out, self.due = " " + out if self.due and tokens else out, self.due or bool(tokens)
        return out

    def finish(self) -> str:
        return "" if self.mode == "surface" else self.machine.decode(b"", True)


def stretches(text: str) -> Iterator[str]:
    """The text in parts that start at white space, which no piece crosses."""
    at, edge = 0, regex.compile(f"[{SPACE}]")
    while len(text) - at > STRETCH:
        cut = edge.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def latin_piece() -> str:
    """The same splitting for texts of Latin-1 characters, whose classes can be listed: the plain engine is faster."""
    listed = lambda some: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(some, c))
    letters, numbers, space = listed(r"\p{L}"), listed(r"\p{N}"), listed(f"[{SPACE}]")
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


def normal(text: str) -> str:
    """Composed and lower case, character by character: a final sigma gets no form of its own."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def coded(model: dict, text: str) -> Iterator[tuple[list[tuple[str, int, str]], int]]:
    """For each stretch: (ids as text, number of ids, surface text) of its pieces, and the number of ids in all."""
    state = model["state"]
    young, old = state.setdefault("young", {}), state.setdefault("old", {})
    if "pieces" not in state:
        state["pieces"], state["latin"] = regex.compile(PIECE), re.compile(latin_piece())
        state["special"] = regex.compile("|".join(map(regex.escape, model["special"]))) if model["special"] else None
    special, surface = state["special"], model["surface"]

    def find(some: str) -> list[str]:
        try:
            some.encode("latin-1")
        except UnicodeEncodeError:
            return state["pieces"].findall(some)
        return state["latin"].findall(some)

    def fresh(piece: str) -> tuple[str, int, str]:
        out = old.get(piece)
        if out is None:
            raw = piece.encode()
            ids = whole_piece(model, raw) if len(raw) <= model["longest"] + model["lookahead"] else list(stream(model, raw))
            decoder = Decoder(model, "surface")
            out = " ".join(map(str, ids)), len(ids), decoder.feed_all(ids)
        if len(piece) <= LONG_PIECE:
            if len(young) >= REMEMBERED:
                old.clear()
                old.update(young)
                young.clear()
            young[piece] = out
        return out

    def plain(part: str):
        for some in stretches(part):
            yield [young.get(p) or fresh(p) for p in find(normal(some))]

    at = 0
    for mark in special.finditer(text) if special else ():
        yield from plain(text[at:mark.start()])
        token = model["special"][mark.group()]
        yield [(str(token), 1, surface[token])]
        at = mark.end()
    yield from plain(text[at:])


def encode(model: dict, text: str) -> list[int]:
    return [int(i) for some in coded(model, text or "") for ids, _, _ in some for i in ids.split(" ")]


def decode(model: dict, ids: list[int], mode: str = "text") -> str:
    decoder = Decoder(model, mode)
    return "".join([*map(decoder.feed, ids), decoder.finish()])


def digest(model: dict, text: str | None) -> tuple[int, str, str]:
    """Number of tokens and the hashes of the ids and of the decoded text, fed stretch by stretch."""
    count, ids, plain = 0, sha256(), sha256()
    for some in coded(model, text or ""):
        if some:
            gap = b" " if count else b""
            ids.update(gap + " ".join([x[0] for x in some]).encode())
            plain.update(gap + " ".join([x[2] for x in some]).encode())
            count += sum([x[1] for x in some])
    return count, ids.hexdigest(), plain.hexdigest()


def _per_text(df: DataFrame, model_path: str, columns: dict[str, pa.DataType], ddl: str, one) -> DataFrame:
    """``df`` with the columns that ``one(model, text)`` gives for each text; columns of those names are replaced."""
    model = df.sparkSession.sparkContext.broadcast(load(model_path))
    kept = df.drop(*columns)

    def run(batches):
        tables = model.value  # lives as long as the worker, and with it what it remembers
        for batch in sliced(batches):
            rows = [one(tables, t) for t in batch.column("text").to_pylist()]
            parts = zip(*rows, strict=True) if rows else [[] for _ in columns]
            new = [pa.array(part, kind) for part, kind in zip(parts, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, {ddl}")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``token_ids`` of each text."""
    return _per_text(docs, model_path, {"token_ids": pa.list_(pa.int32())}, "token_ids array<int>", lambda m, t: (encode(m, t),))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens and the hashes of the ids and of what they decode to."""
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    rows = _per_text(docs.select("doc_id", "text"), model_path, columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)
    return rows.drop("text")


def _tokenized(model: dict, text: str | None) -> tuple[np.ndarray, int, str]:
    parts, plain, decoder = [np.zeros(0, np.int32)], sha256(), Decoder(model, "surface")
    for some in coded(model, text or ""):
        if some:
            parts.append(np.array(" ".join([x[0] for x in some]).split(" "), np.int32))
            plain.update(decoder.feed_all(parts[-1].tolist()).encode())
    ids = np.concatenate(parts)
    return ids, len(ids), plain.hexdigest()


def tokenized(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with token_ids, n_tokens and decoded_sha256, the hash of what the ids decode to."""
    columns = {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded_sha256": pa.string()}
    return _per_text(docs, model_path, columns, "token_ids array<int>, n_tokens bigint, decoded_sha256 string", _tokenized)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``token_ids``; null ids give the empty text."""
    model = rows.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd
        return pd.Series([decode(model.value, [] if x is None else list(x)) for x in ids], dtype=object)

    return rows.withColumn("decoded", text("token_ids"))
