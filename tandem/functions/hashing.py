"""Signatures: 32-bit FNV-1a over UTF-16 units, in base 36; MD5 that goes on from a state."""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import points
from .text import text_of

#: Offset and prime of the hash.
OFFSET, PRIME = 2166136261, 16777619
FIELD, ROW = "\u001f", "\u001e"


def utf16_units(text: Column) -> Column:
    """Code units; a code point over U+FFFF gives two."""

    def units(ch: Column) -> Column:
        point = F.ascii(ch).cast("long")
        rest = point - 0x10000
        return F.when(point < 0x10000, F.array(point)).otherwise(F.array(F.lit(0xD800) + F.shiftright(rest, 10), F.lit(0xDC00) + rest.bitwiseAND(0x3FF)))

    return F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), units))


def short_hash(c) -> Column:
    start = F.lit(OFFSET).cast("long")
    value = F.aggregate(utf16_units(text_of(c)), start, lambda h, u: (h.bitwiseXOR(u) * F.lit(PRIME).cast("long")).bitwiseAND(0xFFFFFFFF))
    return short(value)


def short(value: Column) -> Column:
    """A number in base 36."""
    return F.lower(F.conv(value.cast("string"), 10, 36))


#: Code points of the texts that are hashed side by side.
HASHED = 1 << 23


@F.pandas_udf(LongType())
def _hashed(s: pd.Series) -> pd.Series:
    texts = s.tolist()
    found = [points.fnv_1a(texts[part], OFFSET, PRIME) for part in points.pieces(np.array(list(map(len, texts)), np.int64), HASHED)]
    return pd.Series(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64))


def row_signature(jp, cn, tw, tw_cn, relation) -> Column:
    """The short hash of a row's fields. Rows are many and long, so batches of them are hashed side by side."""
    return short(_hashed(F.concat_ws(FIELD, *[text_of(c) for c in (jp, cn, tw, tw_cn, relation)])))


def table_signature(index: Column, signature: Column) -> Column:
    """An aggregate: the hash of all rows' signatures in order of index."""
    rows = F.sort_array(F.collect_list(F.struct(index.alias("i"), signature.alias("s"))))
    return short_hash(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["i"].cast("string"), r["s"])), ROW))


def project_signature(files: dict[str, str | Column], input_mode: str, start_markers: str, inline_markup: str, comparison_mode: str) -> Column:
    """Of a selection; files by role, a path or a column of paths; the two JSON texts as they are stored, inline_markup without a false noteref."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = [files.get(r, "") for r in ("jp", "cn", "tw")] + (["bilingual"] if comparison_mode == "bilingual" else [])
    return short_hash(F.concat_ws(FIELD, *map(column, [*parts, input_mode, start_markers, inline_markup])))


# ---- MD5 from part to part ----

#: Bytes of OpenSSL's MD5_CTX: 22 words and a count.
_STATE = 92


def _crypto():
    """The library that Python's own hashes use; hashlib does not give a hash's state away, its MD5_CTX is plain data."""
    import _hashlib

    for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
        lib = ctypes.CDLL(name) if name else None
        if lib is not None and hasattr(lib, "MD5_Update"):
            lib.MD5_Init.argtypes, lib.MD5_Update.argtypes, lib.MD5_Final.argtypes = [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t], [ctypes.c_char_p, ctypes.c_void_p]
            return lib
    raise RuntimeError("MD5 over several parts needs OpenSSL's MD5_Update")


def _context(state: bytes):
    context = ctypes.create_string_buffer(state, _STATE) if state else ctypes.create_string_buffer(_STATE)
    if not state:
        _crypto().MD5_Init(context)
    return context


def md5_resumed(state: bytes, content: bytes) -> bytes:
    """The state after content; an empty state is the beginning."""
    context = _context(bytes(state))
    _crypto().MD5_Update(context, bytes(content), len(content))
    return context.raw


def md5_ended(state: bytes) -> str:
    context, out = _context(bytes(state)), ctypes.create_string_buffer(16)
    _crypto().MD5_Final(out, context)
    return out.raw.hex()
