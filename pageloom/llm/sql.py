"""Pieces of DuckDB SQL shared by the twins of this package's queries."""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit (DuckDB has no function for it)."""
    zeros = ", ".join(["0::ubigint"] * 8)
    byte = (f"list_reduce(list_concat([xor(crc, code)], [{zeros}]), lambda x, y: "
            "case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)")
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::ubigint)"
    return f"xor(list_reduce(list_concat([4294967295::ubigint], {codes}), lambda crc, code: {byte}), 4294967295::ubigint)"
