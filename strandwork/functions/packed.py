"""k-mers of up to 31 letters as longs, two bits a letter (A 0, C 1, G 2, T 3), so that numbers sort as texts do.

Windows are rolled over whole Arrow batches with numpy: a window costs a few vectorised shifts, whatever k is.
"""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .seq import BASES

#: Letters laid out at a time, and texts taken from a batch together.
CHUNK, TEXTS = 1 << 18, 256
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _i


def check(k: int, most: int = 31) -> int:
    if not 0 < k <= most:
        raise ValueError(f"k-mers of {k} letters do not fit a long: 1 to {most}")
    return k


def letters(code: Column, k: int) -> Column:
    """The text of a code: four letters at a time, looked up in a list of all."""
    cut = [(min(at + 4, k) - at, 2 * (k - min(at + 4, k))) for at in range(0, k, 4)]
    words = {n: F.split(F.lit(" ".join(map("".join, product(BASES, repeat=n)))), " ") for n, _ in cut}
    return F.concat(*[F.get(words[n], F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << 2 * n) - 1)).cast("int")) for n, shift in cut])


def code_of(text: Column) -> Column:
    """The code of a text of at most 31 letters A, C, G, T."""
    return F.conv(F.translate(text, BASES, "0123"), 4, 10).cast("long")


def revcomp(code: Column, k: int) -> Column:
    """The reverse complement's code: letters are swapped in ever larger groups."""
    x = F.bitwise_not(code)
    for shift, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(low)), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def pushed_right(code: Column, base: Column, k: int) -> Column:
    """The k-mer one letter on: the first letter goes, base (0 to 3) comes last."""
    return F.shiftleft(code.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1)), 2).bitwiseOR(base)


def pushed_left(code: Column, base: Column, k: int) -> Column:
    """The k-mer one letter back: base (0 to 3) comes first, the last letter goes."""
    return F.shiftrightunsigned(code, 2).bitwiseOR(F.shiftleft(base, 2 * (k - 1)))


def roll(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k and of their reverse complements, from stretches of doubled length."""
    n = len(codes) - k + 1
    there, back = codes.astype(np.uint64) & np.uint64(3), np.uint64(3) - (codes.astype(np.uint64) & np.uint64(3))
    ahead = rear = None
    done, size = 0, 1
    while True:
        if k & size:
            a, b = there[done : done + n], back[done : done + n]
            ahead = a if ahead is None else (ahead << np.uint64(2 * size)) | a
            rear = b if rear is None else rear | (b << np.uint64(2 * done))
            done += size
        if done == k:
            return ahead, rear
        there, back = (there[:-size] << np.uint64(2 * size)) | there[size:], back[:-size] | (back[size:] << np.uint64(2 * size))
        size *= 2


def _laid_out(texts: list[bytes | None], k: int):
    """(buffer, row of each stretch, start of each in its text, start of each in the buffer), at most about CHUNK letters at a time.

    Long texts are cut into stretches that overlap by k - 1; stretches are told apart by a letter that is no base.
    """
    size = np.array([0 if text is None else len(text) for text in texts], dtype=np.int64)
    rows = np.flatnonzero(size >= k)
    many = (size[rows] - k) // CHUNK + 1
    rows = np.repeat(rows, many)
    starts = (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)) * CHUNK
    size = np.minimum(size[rows] - starts, CHUNK + k - 1)
    begin = np.cumsum(size + 1) - size - 1
    ends = np.append(np.flatnonzero(np.diff(begin // CHUNK)) + 1, len(rows))
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        if a < b:
            parts = [texts[row] if n == len(texts[row]) else texts[row][start : start + n] for row, start, n in zip(rows[a:b].tolist(), starts[a:b].tolist(), size[a:b].tolist(), strict=True)]
            yield b"N".join(parts), rows[a:b], starts[a:b], begin[a:b] - begin[a]


def _valid_windows(body: bytes, k: int):
    """(places, codes, codes of the reverse complements) of the windows without another letter than the four bases."""
    codes = _CODE[np.frombuffer(body, dtype=np.uint8)]
    ahead, rear = roll(codes, k)
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int64)])
    at = np.flatnonzero(bad[k:] == bad[: len(bad) - k])
    return at, ahead[at], rear[at]


def _texts(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _few_texts(batches):
    """Batches of TEXTS texts at most: what is made of them at a time does not grow with Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _placed(batches, k: int, both: bool):
    for batch in _few_texts(batches):
        keep, texts = batch.columns[:-1], _texts(batch.column(batch.num_columns - 1))
        for body, rows, starts, at in _laid_out(texts, k):
            place, ahead, rear = _valid_windows(body, k)
            part = np.searchsorted(at, place, side="right") - 1
            code = np.minimum(ahead, rear) if both else ahead
            taken = pa.array(rows[part])
            made = [pa.array(starts[part] + place - at[part] + 1), pa.array(code.view(np.int64)), pa.array(code == ahead)]
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in keep), *made], names=[*batch.schema.names[:-1], "pos", "code", "same"])


def windows(df: DataFrame, seq: str, k: int, keep: list[str], both: bool = True) -> DataFrame:
    """keep + (pos from 1, code, same): valid windows of every text, canonical if both strands count; same: as it stands."""
    check(k)
    rows = df.select(*keep, seq)
    kind = StructType([*(rows.schema[c] for c in keep), StructField("pos", LongType()), StructField("code", LongType()), StructField("same", BooleanType())])
    return rows.mapInArrow(partial(_placed, k=k, both=both), kind)


def _placed_sums(batches, k: int):
    for batch in _few_texts(batches):
        keep, texts = batch.columns[:-1], _texts(batch.column(batch.num_columns - 1))
        rows = [i for i, text in enumerate(texts) if text is not None and len(text) >= k]
        if not rows:
            continue
        size = np.array([len(texts[i]) for i in rows])
        body = np.frombuffer(b"".join([texts[i] for i in rows]), dtype=np.uint8)
        begin, n = np.cumsum(size) - size, size - k + 1
        place = np.arange(1, len(body) + 1) - np.repeat(begin, size)
        total = np.concatenate([[0], np.cumsum(body * place)])
        made = [pa.array(total[begin + n] - total[begin]), pa.array(n)]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in keep), *made], names=[*batch.schema.names[:-1], "s", "n"])


def placed_sums(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """keep + (s, n): of all windows of k letters of each text (seq.windows) the sum of first letter's code times place, and their number.

    Letters are of one byte each. A row a text: no window is one. Texts without a window have none.
    """
    rows = df.select(*keep, seq)
    kind = StructType([*(rows.schema[c] for c in keep), StructField("s", LongType()), StructField("n", LongType())])
    return rows.mapInArrow(partial(_placed_sums, k=k), kind)


def _parts(texts: list[bytes | None], size: int, margin: int):
    """(buffer, row of each part, start of its own windows, start of its letters, place in the buffer): as _laid_out, with `margin` letters about."""
    parts, rows, starts, begins, at, length = [], [], [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < size:
            continue
        for start in range(0, len(text) - size + 1, CHUNK):
            begin = max(0, start - margin)
            part = text[begin : start + CHUNK + size - 1 + margin]
            for x, y in ((parts, part), (rows, row), (starts, start), (begins, begin), (at, length)):
                x.append(y)
            length += len(part) + 1
            if length >= CHUNK:
                yield b"N".join(parts), *(np.array(x) for x in (rows, starts, begins, at))
                parts, rows, starts, begins, at, length = [], [], [], [], [], 0
    if parts:
        yield b"N".join(parts), *(np.array(x) for x in (rows, starts, begins, at))


def _beside(codes: np.ndarray, place: np.ndarray, way: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of up to `far` letters from each place on, the nearest lowest, up to the first that is no base."""
    code, count, going = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int32), np.ones(len(place), dtype=bool)
    for d in range(far):
        at = place + way * d
        inside = (at >= 0) & (at < len(codes))
        letter = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], 4).astype(np.int64)
        going &= letter < 4
        code |= np.where(going, letter, 0) << (2 * d)
        count += going
    return code, count


def _in_context(batches, size: int, step: int, far: int):
    for batch in batches:
        keep, texts = batch.columns[:-1], _texts(batch.column(batch.num_columns - 1))
        for body, rows, starts, begins, at in _parts(texts, size, far):
            place, code, _ = _valid_windows(body, size)
            part = np.searchsorted(at, place, side="right") - 1
            pos = place - at[part] + begins[part]
            own = (pos >= starts[part]) & (pos < starts[part] + CHUNK) & (pos % step == 0)
            place, part, pos, code = place[own], part[own], pos[own], code[own]
            codes = _CODE[np.frombuffer(body, dtype=np.uint8)]
            before, after = _beside(codes, place - 1, -1, far), _beside(codes, place + size, 1, far)
            taken = pa.array(rows[part])
            made = [pa.array(x) for x in ((pos + 1).astype(np.int64), code.view(np.int64), *before, *after)]
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in keep), *made], names=[*batch.schema.names[:-1], "pos", "code", "before", "n_before", "after", "n_after"])


def sampled_windows(df: DataFrame, seq: str, size: int, step: int, far: int, keep: list[str]) -> DataFrame:
    """keep + (pos from 1, code, before, n_before, after, n_after): valid windows at every step-th place, with up to `far` letters on both sides."""
    check(size)
    rows = df.select(*keep, seq)
    context = [StructField(n, IntegerType() if n in ("n_before", "n_after") else LongType()) for n in ("pos", "code", "before", "n_before", "after", "n_after")]
    return rows.mapInArrow(partial(_in_context, size=size, step=step, far=check(far + 1) - 1), StructType([*(rows.schema[c] for c in keep), *context]))


#: Letters of a window that may hold other signs than the four bases: three bits each.
ANY = 21


def _any_letters(batches, k: int):
    for batch in batches:
        keep, texts = batch.columns[:-1], _texts(batch.column(batch.num_columns - 1))
        for body, rows, starts, at in _laid_out(texts, k):
            codes = _CODE[np.frombuffer(body, dtype=np.uint8)].astype(np.int64)
            code = np.zeros(len(codes) - k + 1, dtype=np.int64)
            for d in range(k):
                code = (code << 3) | codes[d : d + len(code)]
            place = np.arange(len(code))
            part = np.searchsorted(at, place, side="right") - 1
            ends = np.append(at[1:] - 1, len(body))
            own = place + k <= ends[part]
            place, part, code = place[own], part[own], code[own]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows[part])) for c in keep), pa.array((starts[part] + place - at[part] + 1).astype(np.int64)), pa.array(code)], names=[*batch.schema.names[:-1], "pos", "code"])


def any_windows(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """keep + (pos from 1, code): all windows of k letters (ANY at most) of A, C, G, T and one sign for all others."""
    rows = df.select(*keep, seq)
    kind = StructType([*(rows.schema[c] for c in keep), StructField("pos", LongType()), StructField("code", LongType())])
    return rows.mapInArrow(partial(_any_letters, k=check(k, ANY)), kind)


def _found(known: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each code among the known ones, sorted, whether it is one)."""
    at = np.searchsorted(known, code)
    return at, known[np.minimum(at, len(known) - 1)] == code


#: Letters of a window after which only beginnings of known windows go on, and letters whose codes are counted in a table.
PRUNED, TABLE = (5, 8, 12), 5


def _known(batches, known: dict[int, np.ndarray]):
    sizes, most = sorted(known), max(known)
    begun = {d: np.unique(np.concatenate([known[n] >> 3 * (n - d) for n in sizes if n > d])) for d in PRUNED if most > d}
    total = {n: np.zeros(len(known[n]), dtype=np.int64) for n in sizes}
    names = ["size", "code", "n", "ref_id", "pos"]
    kind = None
    for batch in _few_texts(batches):
        kind = batch.column(0).type
        rows, texts = zip(*[x for x in enumerate(_texts(batch.column(1))) if x[1]] or [(-1, b"")], strict=True)
        length = np.array([len(t) for t in texts])
        ends = np.cumsum(length + 1) - 1
        codes = np.concatenate([_CODE[np.frombuffer(b"N".join([*texts, b""]), dtype=np.uint8)], np.full(most, 7, dtype=np.uint8)]).astype(np.int64)
        codes[ends] = 7  # no pattern holds this sign
        for a in range(0, int(ends[-1]), CHUNK):
            n = min(CHUNK, int(ends[-1]) - a)
            code, place = np.zeros(n, dtype=np.int64), None
            for d in range(most):
                code = (code << 3) | (codes[a + d : a + d + n] if place is None else codes[place + d])
                if d + 1 in known and d + 1 <= TABLE:
                    total[d + 1] += np.bincount(code, minlength=8 ** (d + 1))[known[d + 1]]
                elif d + 1 in known:
                    at, hit = _found(known[d + 1], code)
                    if d + 1 < ANY:
                        total[d + 1] += np.bincount(at[hit], minlength=len(known[d + 1]))
                    elif hit.any():
                        where = np.flatnonzero(hit) + a if place is None else place[hit]
                        row = np.searchsorted(ends, where)
                        made = [np.full(len(where), ANY, dtype=np.int32), code[hit], np.ones(len(where), dtype=np.int64), batch.column(0).take(pa.array(np.array(rows)[row])), where - ends[row] + length[row] + 1]
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names)
                if d + 1 in begun:
                    going = _found(begun[d + 1], code)[1]
                    code, place = code[going], np.flatnonzero(going) + a if place is None else place[going]
    for size in sizes if kind is not None else []:
        met = np.flatnonzero(total[size])
        if len(met):
            made = [pa.array(np.full(len(met), size, dtype=np.int32)), pa.array(known[size][met]), pa.array(total[size][met]), pa.nulls(len(met), kind), pa.nulls(len(met), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=names)


def known_windows(refs: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """(size, code, n, ref_id, pos): of the references' windows (any_windows) those of known codes, sorted by size, in one pass.

    Windows of fewer letters than ANY are counted in their task (n, no ref_id and pos), those of ANY letters come with their places.
    """
    rows = refs.select("ref_id", "seq")
    kind = StructType([StructField("size", IntegerType()), StructField("code", LongType()), StructField("n", LongType()), rows.schema["ref_id"], StructField("pos", LongType())])
    return rows.mapInArrow(partial(_known, known=known), kind)


def any_code(text: Column) -> Column:
    """The code that any_windows gives a text of at most ANY letters."""
    return F.conv(F.regexp_replace(F.translate(text, BASES, "0123"), "[^0-3]", "4"), 8, 10).cast("long")


def _counted(batches, k: int, both: bool):
    for batch in batches:
        for body, *_ in _laid_out(_texts(batch.column(0)), k):
            _, ahead, rear = _valid_windows(body, k)
            code, n = np.unique(np.minimum(ahead, rear) if both else ahead, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


def counts(df: DataFrame, seq: str, k: int, both: bool = True) -> DataFrame:
    """(code, n), added up within each stretch of a batch: sum n by code. Windows of 32 letters wrap into negative longs."""
    check(k, 32)
    return df.select(seq).mapInArrow(partial(_counted, k=k, both=both), "code long, n long")


def _table_sums(batches, tables: dict[int, np.ndarray]):
    for batch in _few_texts(batches):
        for size, table in tables.items():
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for body, rows, _, at in _laid_out(_texts(batch.column(1)), size):
                place, ahead, _ = _valid_windows(body, size)
                n += np.bincount(rows[np.searchsorted(at, place, side="right") - 1], table[ahead], minlength=batch.num_rows).astype(np.int64)
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(np.full(len(kept), size, dtype=np.int32)), pa.array(n[kept])], names=["query_id", "size", "n"])


def table_sums(texts: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """(query_id, size, n): for each size the table's numbers at the codes of a text's (query_id, seq) windows, added up; no row where that is none."""
    rows = texts.select(F.col("query_id").cast("long"), "seq")
    return rows.mapInArrow(partial(_table_sums, tables=tables), "query_id long, size int, n long")


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """function(*columns as numpy arrays) -> columns, over Arrow batches of columns without nulls."""

    def run(batches):
        for batch in batches:
            out = function(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[x.strip().split(" ")[0] for x in schema.split(",")])

    return df.mapInArrow(run, schema)


def turned(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of codes."""
    x = ~code.view(np.uint64)
    for shift, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = ((x >> np.uint64(shift)) & np.uint64(low)) | ((x & np.uint64(low)) << np.uint64(shift))
    return ((x >> np.uint64(32)) | (x << np.uint64(32))) >> np.uint64(64 - 2 * k)
