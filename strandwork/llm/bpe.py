"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .tokens import one_blank_apart

#: Characters of text whose new words are encoded together: a task's unit of memory.
PACK_CHARS = 10_000_000
#: Words that a task remembers from pack to pack; beyond it starts anew.
KNOWN_WORDS = 700_000
#: Words whose ids are laid out at a time, or one document's if it has more.
APPLY_WORDS = 500_000
BATCH_BYTES = "32m"
#: Words of more bytes are looked through for places where no token can reach over.
LONG = 5
NO_RANK = 1 << 16
#: A cell of the rank map that nobody owns.
FREE = 1 << 40


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[list[int], list[int]]:
    """The rank map by pairs of ids: (starts, cells).

    The join of the pieces a and b has the rank r if cells[starts[a] + b] = a * 65536 + r, and none if another piece or
    nobody (FREE) owns that cell. The rows of all a are laid over each other so that no two pairs share a cell, large
    rows first. Ranks are ids here, as in every tiktoken file, and fit in 16 bits.
    """
    ranks = load_ranks(path)
    if len(ranks) > 1 << 16 or max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits do not fit the fold's state")
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    free = np.ones((1 << 16) + 4 * sum(map(len, rows.values())), dtype=bool)
    cells = np.full(len(free), FREE, dtype=np.int64)
    draw, starts, end = np.random.default_rng(0), [0] * (1 << 16), 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        at, start, tries = np.array([b for b, _ in row]), None, 4
        while start is None:
            places = draw.integers(0, len(free) - (1 << 16), tries)
            fits = np.flatnonzero(free[places[:, None] + at[None, :]].all(axis=1))
            start, tries = (int(places[fits[0]]) if len(fits) else None), 256
        free[start + at], cells[start + at], starts[a] = False, [(a << 16) + r for _, r in row], start
        end = max(end, start + int(at.max()) + 1)
    return starts, cells[:end].tolist()


@lru_cache(maxsize=2)
def bigrams(path: str) -> frozenset[tuple[int, int]]:
    """Neighbouring bytes of all tokens. Merges never reach over two bytes that no token holds side by side."""
    return frozenset(pair for t in load_ranks(path) for pair in zip(t, t[1:], strict=False))


def parts_of(word: bytes, path: str) -> list[bytes]:
    """A word cut where no token can reach over: its ids are those of the parts, and the fold, quadratic in length, is short.

    Words of texts share such parts, so fewer are folded than there are words.
    """
    if len(word) <= LONG:
        return [word]
    pairs = bigrams(path)
    if pairs.issuperset(zip(word, word[1:])):  # noqa: B905
        return [word]
    cuts = [0, *(i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in pairs), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: what an empty fold ends with is bound, a repeated expression is not."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def literal(numbers: list[int], row: Column, kind: str) -> Column:
    """A literal array, read from its text once a row: the optimizer would compare a folded one over and over again."""
    return F.split(F.when(row.isNotNull(), F.lit(",".join(map(str, numbers)))), ",").cast(f"array<{kind}>")


def merged_words(words: Column, whole: Column, path: str) -> Column:
    """(ids, body) of each word of an array of byte arrays: its ids, and the bytes that these decode to.

    whole: the id of each word that is a token as it stands, else -1. Other words are folded: their pieces are at first
    their bytes, a piece is one long (rank of its join with the next piece, place, id), so the least piece is the
    leftmost of least rank, and each step of the fold joins it with the next one and looks two ranks up in the literal
    rank map. The fold has as many steps as there can be merges. Decoding concatenates the tokens' binary pieces.
    """
    ranks = load_ranks(path)
    none, least = F.lit(NO_RANK << 32), F.lit(NO_RANK).cast("long")

    def with_tables(singles: Column, starts: Column, cells: Column, pieces: Column) -> Column:
        def piece(a: Column, b: Column, place: Column) -> Column:
            """place: the piece's place in bits 16 to 31. A cell of another owner differs from a above bit 15."""
            wide = a.cast("long")
            rank = F.least(F.get(cells, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(wide, 16)), least)
            return F.shiftleft(rank, 32).bitwiseOR(place).bitwiseOR(wide)

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit(0xFFFF)).cast("int")

        def place_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit(0xFFFF0000))

        def join_at(s: Column, m: Column, k: Column) -> Column:
            """s with its k-th piece m (from 1) and the next one joined: both and the piece before are worked out anew."""
            new, before, rest = F.shiftright(m, 32).cast("int"), F.get(s, k - 2), F.slice(s, k + 2, F.size(s))
            here = piece(new, id_of(F.get(s, k + 1)), place_of(m))
            return F.when(k == 1, F.concat(F.array(here), rest)).otherwise(F.concat(F.slice(s, F.lit(1), k - 2), F.array(piece(id_of(before), new, place_of(before)), here), rest))

        def step(s: Column, _: Column) -> Column:
            return let(F.array_min(s), lambda m: F.when(m < none, let(F.array_position(s, m).cast("int"), lambda k: join_at(s, m, k))).otherwise(s))

        def fold(word: Column) -> Column:
            ids = F.transform(word, lambda b: F.get(singles, b.cast("int")))
            start = let(ids, lambda x: F.transform(x, lambda a, i: piece(a, F.get(x, i + 1), F.shiftleft(i.cast("long"), 16))))
            return F.aggregate(F.slice(word, F.lit(2), F.size(word)), start, step, lambda s: F.transform(s, id_of))

        def decoded(ids: Column) -> Column:
            body = F.aggregate(ids, F.lit(b""), lambda x, i: F.concat(x, F.get(pieces, i)))
            return F.struct(ids.alias("ids"), body.alias("body"))

        return F.transform(words, lambda w, i: let(F.when(F.get(whole, i) >= 0, F.array(F.get(whole, i))).otherwise(fold(w)), decoded))

    starts, cells = pair_table(path)
    spelt = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelt[i] = token
    pieces = F.transform(F.split(F.when(words.isNotNull(), F.lit(",".join(t.hex() for t in spelt))), ","), lambda h: F.unhex(h))
    tables = [literal([ranks[bytes([b])] for b in range(256)], words, "int"), literal(starts, words, "int"), literal(cells, words, "bigint"), pieces]
    return let(tables[0], lambda a: let(tables[1], lambda b: let(tables[2], lambda c: let(tables[3], lambda d: with_tables(a, b, c, d)))))


def byte_arrays(words: list[bytes]) -> pa.Array:
    """Words as arrays of their bytes, as Spark takes them."""
    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int16)))


def _packs(batches, pattern: str, chars: int, known: int, ranks_path: str):
    """A row for every `chars` characters: the bytes of their words that the task has not met, whole tokens among them, and
    each document as numbers of words. anew: words are numbered from 0 again, and those before are forgotten."""
    import regex

    find, ranks = regex.compile(pattern).findall, load_ranks(ranks_path)
    numbers, parts, fresh = {}, {}, []

    def spell(word: str) -> bytes:
        out = b""
        for part in parts_of(word.encode(), ranks_path):
            n = numbers.get(part)
            if n is None:
                numbers[part] = n = len(numbers)
                fresh.append(part)
            out += n.to_bytes(4, "little")
        return out

    class Spelt(dict):
        def __missing__(self, word: str) -> bytes:
            self[word] = out = spell(word)
            return out

    class Parts(dict):
        def __missing__(self, unit: str) -> bytes:
            self[unit] = out = b"".join([spell(w) for w in find(" " + unit)])
            return out

    spelt, parts = Spelt(), Parts()

    def pack(anew):
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([seqs], pa.list_(pa.binary()))]
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), byte_arrays(fresh)))
        columns.append(pa.array([[ranks.get(w, -1) for w in fresh]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([*columns, pa.array([anew])], names=["doc_ids", "seqs", "words", "whole", "anew"])

    ids, seqs, size, anew = [], [], 0, True
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if one_blank_apart(text):
                head, *units = text.split(" ")
                seqs.append(b"".join([spelt[w] for w in find(head)]) + b"".join([parts[u] for u in units]))
            else:
                seqs.append(b"".join([spelt[w] for w in find(text)]))
            ids.append(doc_id)
            size += len(text) + 64
            if size >= chars:
                yield pack(anew)
                fresh.clear()
                parts.clear()
                spelt.clear()
                ids, seqs, size, anew = [], [], 0, len(numbers) > known
                if anew:
                    numbers.clear()
    if ids:
        yield pack(anew)


def _whole(words: pa.Array, seqs: list[bytes], ends: pa.Array, blank) -> list:
    """Each document's words, joined by blank."""
    taken = words.take(pa.array(np.frombuffer(b"".join(seqs), dtype="<u4").astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(ends, taken), blank).to_pylist()


def _apply(batches, top: int):
    number = pa.array([str(i) for i in range(top + 1)])
    text = body = counts = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            made = row.column("made")[0].values
            table = made.field("ids")
            n = pc.list_value_length(table).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, flat = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), table.flatten()
            new = [pc.binary_join(pa.ListArray.from_arrays(starts, number.take(flat)), " "), made.field("body"), n]
            if row.column("anew")[0].as_py():
                text, body, counts = new
            else:
                text, body, counts = pa.concat_arrays([text, new[0]]), pa.concat_arrays([body, new[1]]), np.concatenate([counts, n])
            doc_ids, seqs, at = row.column("doc_ids")[0].as_py(), row.column("seqs")[0].as_py(), 0
            while at < len(seqs):
                to, n = at + 1, len(seqs[at])
                while to < len(seqs) and n + len(seqs[to]) <= 4 * APPLY_WORDS:
                    n, to = n + len(seqs[to]), to + 1
                some = seqs[at:to]
                ends = np.cumsum([0, *(len(x) // 4 for x in some)]).astype(np.int32)
                tokens = np.concatenate([[0], np.cumsum(counts[np.frombuffer(b"".join(some), dtype="<u4")])])[ends]
                ids_sha = [hashlib.sha256(x.encode()).hexdigest() for x in _whole(text, some, pa.array(ends), " ")]
                body_sha = [hashlib.sha256(x).hexdigest() for x in _whole(body, some, pa.array(ends), b"")]
                out = [pa.array(doc_ids[at:to], pa.int64()), pa.array(np.diff(tokens).astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(body_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = to


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded without special tokens and decoded.

    Each task gathers its texts into packs of about PACK_CHARS characters, folds the words that it has not met yet and
    applies their ids: nothing is shuffled, stored or broadcast, a common word is merged once a task (once in KNOWN_WORDS
    words of a large one), and a lost task is run again from its input alone. Words of any length are folded; long ones
    are cut first where no token can reach over. A word decodes to its tokens' binary pieces, concatenated by Spark, and
    a text to its words. Null and empty texts have no tokens; repeated rows and null keys keep a row each; other columns
    are ignored; no rows give no rows.
    """
    arrow_batches(df.sparkSession, 500)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gather = partial(_packs, pattern=pattern, chars=PACK_CHARS, known=KNOWN_WORDS, ranks_path=ranks_path)
    packs = rows.mapInArrow(gather, "doc_ids array<long>, seqs array<binary>, words array<array<smallint>>, whole array<int>, anew boolean")
    made = packs.select("doc_ids", "seqs", "anew", merged_words(F.col("words"), F.col("whole"), ranks_path).alias("made"))
    top = max(load_ranks(ranks_path).values())
    return made.mapInArrow(partial(_apply, top=top), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
