"""Pieces of the DuckDB statements that the registered queries are held against."""

from __future__ import annotations

CODE = "greatest(-32768, least(32767, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)))"
IQ = f"""iq AS (
    SELECT e.vec_id // 2 AS row, list_transform(e.embedding, lambda x: {CODE}) AS re, list_transform(o.embedding, lambda x: {CODE}) AS im
    FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1 WHERE e.vec_id % 2 = 0
)"""
LONG = IQ + """, iql AS (
    SELECT row, CAST(unnest(range(0, len(re))) AS INTEGER) AS col, unnest(re) AS re, unnest(im) AS im FROM iq
)"""
IMAGE = LONG + """, img AS (
    SELECT row, col, CAST(least(65535, CAST(floor(sqrt(CAST(re * re + im * im AS DOUBLE))) AS BIGINT)) AS INTEGER) AS mag FROM iql
)"""
#: The whole frame with lines of zeros up to a whole number of looks of 64 lines.
SQUARE = IQ + """, sq AS (
    SELECT row, re, im FROM iq UNION ALL
    SELECT r AS row, list_transform(range(0, 64), lambda i: CAST(0 AS BIGINT)) AS re, list_transform(range(0, 64), lambda i: CAST(0 AS BIGINT)) AS im
    FROM (SELECT unnest(range(h, ((h + 63) // 64) * 64)) AS r FROM (SELECT max(row) + 1 AS h FROM iq))
)"""

#: CTE tab: the CRC-32 table, from its polynomial.
CRC_TABLE = """bits AS (SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) t(b)),
    tab AS (SELECT list(v ORDER BY b) AS t FROM bits)"""


def crc(y: str) -> str:
    """CRC-32 of a list of bytes, beside tab."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {y}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def bits(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN length(bin({x})) ELSE 0 END)"


def wrap16(x: str) -> str:
    return f"(xor(({x}) & 65535, 32768) - 32768)"


def wrap48(x: str) -> str:
    return f"(xor(({x}) & 281474976710655, 140737488355328) - 140737488355328)"


def sat16(x: str) -> str:
    return f"greatest(-32768, least(32767, {x}))"


def cos_q15(k: str, n: int) -> str:
    return f"CAST(least(32767, floor(cos(2 * pi() * ({k}) / {n}) * 32768)) AS BIGINT)"


def sin_q15(k: str, n: int) -> str:
    """Of -sin."""
    return f"CAST(least(32767, floor(-sin(2 * pi() * ({k}) / {n}) * 32768)) AS BIGINT)"


def hamming_q15(k: str, n: int) -> str:
    return f"CAST(floor((0.54 - 0.46 * cos(2 * pi() * ({k}) / {n - 1})) * 32768) AS BIGINT)"


def swapped(i: str, n: int) -> str:
    """i with its bits in reverse order."""
    bits = n.bit_length() - 1
    return "(" + " + ".join(f"((({i}) >> {b}) & 1) * {1 << (bits - 1 - b)}" for b in range(bits)) + ")"


def fft(src: str, name: str, n: int = 64, halve: bool = False, clip: bool = False, after=None) -> tuple[str, str]:
    """CTEs name0 .. nameK of the staged transform of src (row, re, im); after(stage, cte) may add CTEs and name the next source."""
    put = lambda c: f"list_transform(range(0, {n}), lambda i: {c}[{swapped('i', n)} + 1]) AS {c}"
    out = [f"{name}0 AS (SELECT row, {put('re')}, {put('im')}{', 0 AS exp' if after else ''} FROM {src})"]
    last = f"{name}0"
    for s in range(1, n.bit_length()):
        m, mh = 1 << s, 1 << (s - 1)
        up = f"(i - i % {m} + i % {mh} + 1)"
        tw = f"(i % {mh}) * {n // m}"
        h = " >> 1" if halve else ""
        br, bi = f"(re[{up} + {mh}]{h})", f"(im[{up} + {mh}]{h})"
        c, d = cos_q15(tw, n), sin_q15(tw, n)
        parts = []
        for part, prod in (("re", f"({c} * {br} - {d} * {bi})"), ("im", f"({c} * {bi} + {d} * {br})")):
            t = f"({prod} >> 15)"
            t = sat16(t) if clip else t
            v = f"({part}[{up}]{h}) + (CASE WHEN i % {m} < {mh} THEN 1 ELSE -1 END) * {t}"
            v = sat16(v) if clip and not after else v
            parts.append(f"list_transform(range(0, {n}), lambda i: {v}) AS {part}")
        out.append(f"{name}{s} AS (SELECT row, {', '.join(parts)}{', exp' if after else ''} FROM {last})")
        last = f"{name}{s}"
        if after:
            more, last = after(s, last)
            out.append(more)
    return ", ".join(out), last


def shifted(src: str, exp: str) -> str:
    return ", ".join(f"list_transform({c}, lambda v: {sat16(f'v >> {exp}')}) AS {c}" for c in ("re", "im"))


def pass_l1(src: str, name: str, n: int = 64) -> tuple[str, str]:
    ctes, last = fft(src, name, n)
    e = f"greatest(0, {bits('coalesce(max(l1), 0)')} - 15)"
    l1 = "list_sum(list_transform(re, lambda v: abs(v))) + list_sum(list_transform(im, lambda v: abs(v)))"
    return (
        f"{ctes}, {name}e AS (SELECT {e} AS exp FROM (SELECT CAST({l1} AS BIGINT) AS l1 FROM {src})), "
        f"{name}p AS (SELECT row, {shifted(last, 'exp')}, exp FROM {last}, {name}e)",
        f"{name}p",
    )


def fit(m: str) -> str:
    return f"(CASE WHEN {m} > 32767 THEN {bits(f'(({m} + 32767) // 32767 - 1)')} ELSE 0 END)"


PEAK = "greatest(list_max(list_transform(re, lambda v: abs(v))), list_max(list_transform(im, lambda v: abs(v))))"


def pass_global(src: str, name: str) -> tuple[str, str]:
    ctes, last = fft(src, name)
    return (
        f"{ctes}, {name}e AS (SELECT {fit('coalesce(max(m), 0)')} AS exp FROM (SELECT {PEAK} AS m FROM {last})), "
        f"{name}p AS (SELECT row, {shifted(last, 'exp')}, exp FROM {last}, {name}e)",
        f"{name}p",
    )


def pass_perrow(src: str, name: str) -> tuple[str, str]:
    def after(s, last):
        sh = f"{name}h{s}"
        return (
            f"{sh}m AS (SELECT row, re, im, exp, {PEAK} AS m FROM {last}), {sh}k AS (SELECT row, re, im, exp, {fit('m')} AS sh FROM {sh}m), "
            f"{sh} AS (SELECT row, {shifted(last, 'sh')}, exp + sh AS exp FROM {sh}k)",
            sh,
        )

    return fft(src, name, clip=True, after=after)


def renormalise(src: str, name: str) -> tuple[str, str]:
    v = "list_transform({c}, lambda v: CASE WHEN emax - exp > 12 THEN 0 ELSE v >> (emax - exp) END) AS {c}"
    return f"{name} AS (SELECT row, {v.format(c='re')}, {v.format(c='im')}, exp, emax FROM {src}, (SELECT max(exp) AS emax FROM {src}))", name


def turn(src: str, name: str, n: int = 64) -> tuple[str, str]:
    return (
        f"{name}l AS (SELECT (row // {n}) * {n} + unnest(range(0, {n})) AS row, row % {n} AS col, unnest(re) AS re, unnest(im) AS im FROM {src}), "
        f"{name} AS (SELECT row, list(re ORDER BY col) AS re, list(im ORDER BY col) AS im FROM {name}l GROUP BY row)",
        name,
    )


def taper(src: str, name: str, h: int, w: int) -> tuple[str, str]:
    cw = wrap16(f"({hamming_q15(f'row % {h}', h)} * {hamming_q15('i - 1', w)}) >> 15")
    one = lambda c: f"list_transform({c}, lambda v, i: {wrap16(f'(v * {cw}) >> 15')}) AS {c}"
    return f"{name} AS (SELECT row, {one('re')}, {one('im')} FROM {src})", name


def detect(src: str, n: int = 64) -> str:
    return (
        f"SELECT row, CAST(unnest(range(0, {n})) AS INTEGER) AS col, "
        "unnest(list_transform(list_zip(re, im), lambda z: CAST(least(65535, CAST(floor(sqrt(CAST(z[1] * z[1] + z[2] * z[2] AS DOUBLE))) AS BIGINT)) AS INTEGER))) AS mag "
        f"FROM {src}"
    )


def image(scaling: str, n: int = 64, tapered: bool = True, frame: str = SQUARE) -> str:
    """The whole image formation over the frame sq as a stack of square looks."""
    ctes = [frame]
    src = "sq"
    if tapered:
        more, src = taper(src, "wn", n, n)
        ctes.append(more)
    for name in ("fa", "fb"):
        if scaling == "perrow":
            more, src = pass_perrow(src, name)
            ctes.append(more)
            more, src = renormalise(src, name + "r")
        elif scaling == "uncond":
            more, src = fft(src, name, halve=True, clip=True)
        else:
            more, src = pass_l1(src, name, n) if scaling == "l1" else pass_global(src, name)
        ctes.append(more)
        if name == "fa":
            more, src = turn(src, "ct", n)
            ctes.append(more)
    return f"WITH {', '.join(ctes)} {detect(src, n)}"


def pass_block(src: str, name: str) -> tuple[str, str]:
    """One exponent for the whole block, found after every stage, down only."""

    def after(s, last):
        b = f"{name}b{s}"
        return f"{b}e AS (SELECT {fit('max(m)')} AS sh FROM (SELECT {PEAK} AS m FROM {last})), {b} AS (SELECT row, {shifted(last, 'sh')}, exp + sh AS exp FROM {last}, {b}e)", b

    return fft(src, name, clip=True, after=after)


def scale_exponent(m: str) -> str:
    return f"(CASE WHEN {m} = 0 THEN 0 WHEN {m} > 32767 THEN {bits(f'(({m} + 32766) // 32767 - 1)')} ELSE 1 - {bits(f'(32767 // greatest({m}, 1))')} END)"


def pass_rescaled(src: str, name: str, n: int = 64, by_line: bool = False) -> tuple[str, str]:
    """Mantissas scaled both ways after every stage, by one exponent or one a line; products keep all bits."""
    put = lambda c: f"list_transform(range(0, {n}), lambda i: {c}[{swapped('i', n)} + 1]) AS {c}"
    out = [f"{name}i AS (SELECT row, {put('re')}, {put('im')}, 0 AS exp FROM {src})"]

    def scaled(last, new, off):
        move = lambda c: f"list_transform({c}, lambda v: {sat16('CASE WHEN sh >= 0 THEN v >> greatest(sh, 0) ELSE v * CAST(pow(2, greatest(-sh, 0)) AS BIGINT) END')}) AS {c}"
        if by_line:
            own = f"{new}e AS (SELECT *, CAST({scale_exponent('m')} AS INTEGER) AS sh FROM (SELECT *, {PEAK} AS m FROM {last}))"
            return f"{own}, {new} AS (SELECT row, {move('re')}, {move('im')}, exp + sh - {off} AS exp FROM {new}e)"
        return f"{new}e AS (SELECT CAST({scale_exponent('max(m)')} AS INTEGER) AS sh FROM (SELECT {PEAK} AS m FROM {last})), {new} AS (SELECT row, {move('re')}, {move('im')}, exp + sh - {off} AS exp FROM {last}, {new}e)"

    out.append(scaled(f"{name}i", f"{name}s0", 0))
    for s in range(1, n.bit_length()):
        m, mh = 1 << s, 1 << (s - 1)
        up, tw = f"(i - i % {m} + i % {mh} + 1)", f"(i % {mh}) * {n // m}"
        br, bi, c, d = f"re[{up} + {mh}]", f"im[{up} + {mh}]", cos_q15(tw, n), sin_q15(tw, n)
        v = lambda part, prod: f"list_transform(range(0, {n}), lambda i: {part}[{up}] * 32768 + (CASE WHEN i % {m} < {mh} THEN 1 ELSE -1 END) * ({prod})) AS {part}"
        out.append(f"{name}x{s} AS (SELECT row, {v('re', f'{c} * {br} - {d} * {bi}')}, {v('im', f'{c} * {bi} + {d} * {br}')}, exp FROM {name}s{s - 1})")
        out.append(scaled(f"{name}x{s}", f"{name}s{s}", 15))
    return ", ".join(out), f"{name}s{n.bit_length() - 1}"


def dft2(src: str, name: str, h: int, w: int, centred: bool = True) -> str:
    """CTEs namea and name (row, col, re, im): the two-dimensional transform of every look of h rows of long src by direct sums."""
    one = lambda t: f"sum(re * cos({t}) + im * sin({t})) AS re, sum(im * cos({t}) - re * sin({t})) AS im"
    turns = lambda x, n: f"(2 * pi() * ((({x} - {n // 2 * centred}) * (k - {n // 2 * centred})) % {n}) / {n})"
    return (
        f"{name}a AS (SELECT row, k AS col, {one(turns('col', w))} FROM {src}, range(0, {w}) g(k) GROUP BY ALL), "
        f"{name} AS (SELECT row // {h} * {h} + k AS row, CAST(col AS INTEGER) AS col, {one(turns(f'(row % {h})', h))} FROM {name}a, range(0, {h}) g(k) GROUP BY row // {h}, k, col)"
    )


def dft2_whole(src: str, name: str, w: int) -> str:
    """CTEs of the centred two-dimensional transform of the whole of long src (row, col, re, im, all iq's rows one look) by direct sums: name (row, col, re, im)."""
    one = lambda t: f"sum(re * cos({t}) + im * sin({t})) AS re, sum(im * cos({t}) - re * sin({t})) AS im"
    across = f"(2 * pi() * (((col - {w // 2}) * (k - {w // 2})) % {w}) / {w})"
    down = "(2 * pi() * (((row - h // 2) * (k - h // 2)) % h) / h)"
    return (
        f"{name}h AS (SELECT max(row) + 1 AS h FROM iq), {name}a AS (SELECT row, k AS col, {one(across)} FROM {src}, range(0, {w}) g(k) GROUP BY ALL), "
        f"{name}k AS (SELECT unnest(range(0, h)) AS k, h FROM {name}h), "
        f"{name} AS (SELECT k AS row, CAST(col AS INTEGER) AS col, {one(down)} FROM {name}a, {name}k GROUP BY k, col)"
    )
