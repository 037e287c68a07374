"""Pieces of SQL that several queries' SQL shares."""

from __future__ import annotations

#: Common table expressions (of a `with recursive`) that end in crc_table(tb), the table of CRC-32 by byte; 3988292384 is the polynomial.
CRC_TABLE = """crc_step(i, x, k) as (select i::bigint, i::bigint, 0 from range(256) r(i)
    union all select i, case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from crc_step where k < 8),
crc_table as (select list(x order by i) as tb from crc_step where k = 8)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; tb has to be in scope."""
    coded = f"hex(encode({text}))"
    steps = f"list_concat([4294967295::bigint], [('0x' || {coded}[2 * i - 1 : 2 * i])::bigint for i in range(1, len({coded}) // 2 + 1)])"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295::bigint)"
