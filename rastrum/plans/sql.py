"""SQL of the registered queries, written apart from the operators: joins and windows over whole fixtures, in DuckDB's dialect."""

from __future__ import annotations

from ..functions.morse import CODES
from ..operators.crypto import PATTERNS_22, PATTERNS_24, SCHEMES_24
from ..operators.hiding import ZIGZAG as PLACES

_NUM = "with num as (select vec_id, i, cast(greatest(0, least(255, floor((cast(x as double) + 1) * 127.5))) as integer) as v from (select vec_id, unnest(range(64)) as i, unnest(embedding) as x from embeddings)), "
_TALL = "tall as (select cast(vec_id as integer) as r, cast(i as integer) as c, v from num)"
_TILE = "tile as (select vec_id as image_id, cast(i // 8 as integer) as r, cast(i % 8 as integer) as c, v from num)"
TALL = _NUM + _TALL + " "
TILE = _NUM + _TILE + " "
MIXED = _NUM + _TILE + ", mixed as (select image_id, r, c, case when image_id % 2 = 0 then cast(125 + floor((v - 125) / 8) as integer) else v end as v from tile) "
COLOR = _NUM + _TALL + ", color as (select r, c, cast(k as integer) as ch, case k when 0 then v when 1 then 255 - v else xor(v, 85) end as v from tall, range(3) t(k)) "
BITS_CTE = "bits as (select p as pos, cast(case when p // 8 < 13 then (ascii(substr('Hello, World!', cast(p // 8 + 1 as integer), 1)) >> cast(7 - p % 8 as integer)) & 1 else 0 end as integer) as bit from range(112) t(p))"


def md5_int(key: str, *parts: str) -> str:
    """28 bits of md5 of the key and the parts."""
    text = " || ':' || ".join([f"'{key}'", *(f"cast({p} as varchar)" for p in parts)])
    return "(" + " + ".join(f"(instr('0123456789abcdef', substr(md5({text}), {k}, 1)) - 1) * {16 ** (7 - k)}" for k in range(1, 8)) + ")"


def crop(name: str, side: int) -> str:
    return TALL + f"select cast(0 as bigint) as image_id, r, c, v from {name}, (select max(r) + 1 as h, max(c) + 1 as w from {name}) where r < h - h % {side} and c < w - w % {side}"


PAD = TALL + ", size as (select max(r) as h, max(c) as w from tall) select cast(0 as bigint) as image_id, cast(y.t as integer) as r, cast(x.t as integer) as c, v from size, lateral (select unnest(range((h // 24 + 1) * 24)) as t) y, lateral (select unnest(range((w // 24 + 1) * 24)) as t) x join tall on tall.r = least(y.t, h) and tall.c = least(x.t, w)"
BLOCKS = TILE + "select image_id, cast(r // 4 as integer) as br, cast(c // 4 as integer) as bc, string_agg(cast(v as varchar), ',' order by r, c) as vec from tile group by image_id, r // 4, c // 4"
RESIZE = (
    TILE
    + ", y as (select t, floor(s) as lo, s - floor(s) as f from (select t, greatest(0.0, least((t + 0.5) * 8 / 5 - 0.5, 7.0)) as s from range(5) g(t)))"
    + ", x as (select t, floor(s) as lo, s - floor(s) as f from (select t, greatest(0.0, least((t + 0.5) * 8 / 11 - 0.5, 7.0)) as s from range(11) g(t)))"
    + ", parts as (select p.image_id, y.t as r, x.t as c, p.v * (case when dy = 0 then 1 - y.f else y.f end) * (case when dx = 0 then 1 - x.f else x.f end) as part from y, x, range(2) a(dy), range(2) b(dx), tile p where p.r = least(y.lo + dy, 7) and p.c = least(x.lo + dx, 7))"
    + " select image_id, cast(r as integer) as r, cast(c as integer) as c, cast(floor(round(sum(part), 6) + 0.5) as integer) as v from parts group by image_id, r, c"
)
_TALL_SIZE = "size as (select (max(r) + 1) as h, (max(c) + 1) as w, (max(r) + 1) // 8 * 8 as th, (max(c) + 1) // 8 * 8 as tw from tall)"
RESIZE_LEVELS = (
    TALL
    + f", {_TALL_SIZE}, y as (select t, floor(s) as lo, s - floor(s) as f, h from (select t, h, greatest(0.0::double, least((t + 0.5) * h / th - 0.5, h - 1.0)) as s from size, range(100000) g(t) where t < th))"
    + ", x as (select t, floor(s) as lo, s - floor(s) as f, w from (select t, w, greatest(0.0::double, least((t + 0.5) * w / tw - 0.5, w - 1.0)) as s from size, range(64) g(t) where t < tw))"
    + ", ys as (select t, least(lo + d, h - 1) as r, sum(case when d = 0 then 1 - f else f end) as k from y, range(2) a(d) group by 1, 2), xs as (select t, least(lo + d, w - 1) as c, sum(case when d = 0 then 1 - f else f end) as k from x, range(2) a(d) group by 1, 2)"
    + ", half as (select p.r, xs.t as c, sum(p.v * xs.k) as v from tall p join xs on xs.c = p.c group by p.r, xs.t) select cast(0 as bigint) as image_id, cast(ys.t as integer) as r, cast(half.c as integer) as c, cast(floor(round(sum(half.v * ys.k), 6) + 0.5) as integer) as v from half join ys on ys.r = half.r group by ys.t, half.c"
)
MOSAIC = TILE + "select image_id, cast(p // 4 * 8 + r as integer) as r, cast(p % 4 * 8 + c as integer) as c, cast(((v >> p) & 1) * 255 as integer) as v from tile, (select cast(p as integer) as p from range(8) t(p))"

_MIRROR = "size as (select max(r) + 1 as h, max(c) + 1 as w from tall)"


def _convolve(source: str, radius: int, weight: str, result: str) -> str:
    at = lambda x, d, n: f"case when {x} + {d} < 0 then -({x} + {d}) when {x} + {d} >= {n} then 2 * ({n} - 1) - ({x} + {d}) else {x} + {d} end"
    return f"select a.r, a.c, cast({result.format(s=f'sum(b.v * {weight})')} as integer) as v from {source} a, size, range({-radius}, {radius + 1}) p(dy), range({-radius}, {radius + 1}) q(dx), {source} b where b.r = {at('a.r', 'dy', 'h')} and b.c = {at('a.c', 'dx', 'w')} group by a.r, a.c"


_K3 = "case when dy = 0 and dx = 0 then 9 else -1 end"
_K5 = "(case abs(dy) when 0 then 6 when 1 then 4 else 1 end) * (case abs(dx) when 0 then 6 when 1 then 4 else 1 end)"
_SHARP, _BLUR = "greatest(0, least(255, {s}))", "({s} + 128) // 256"
SHARPEN = TALL + ", " + _MIRROR + ", o as (" + _convolve("tall", 1, _K3, _SHARP) + ") select cast(0 as bigint) as image_id, r, c, v from o"
GAUSS = TALL + ", " + _MIRROR + ", o as (" + _convolve("tall", 2, _K5, _BLUR) + ") select cast(0 as bigint) as image_id, r, c, v from o"
BLUR_SHARPEN = TALL + ", " + _MIRROR + ", s as (" + _convolve("tall", 2, _K5, _BLUR) + "), o as (" + _convolve("s", 1, _K3, _SHARP) + ") select cast(0 as bigint) as image_id, r, c, v from o"
_W11 = "(case abs({d}) when 0 then 252 when 1 then 210 when 2 then 120 when 3 then 45 when 4 then 10 else 1 end)"


def _two_passes(source: str, key: str, weight: str, result: str, name: str) -> str:
    """Rows, then columns, of pictures with sizes in ``size``; key: columns that tell pictures apart."""
    at = lambda x, n: f"case when {x} + d < 0 then -({x} + d) when {x} + d >= {n} then 2 * ({n} - 1) - ({x} + d) else {x} + d end"
    k = f"{key}, " if key else ""
    same = f"b.{key} = a.{key} and " if key else ""
    ak = f"a.{key}, " if key else ""
    rows = f"{name}_h as (select {ak}a.r, a.c, sum(b.v * {weight}) as v from {source} a, size, range(-5, 6) p(d), {source} b where {same}b.r = a.r and b.c = {at('a.c', 'w')} group by {ak}a.r, a.c)"
    return rows + f", {name} as (select {k}r, c, cast({result.format(s='s')} as integer) as v from (select {ak}a.r, a.c, sum(b.v * {weight}) as s from {name}_h a, size, range(-5, 6) p(d), {name}_h b where {same}b.c = a.c and b.r = {at('a.r', 'h')} group by {ak}a.r, a.c))"


GAUSS11 = TALL + ", " + _MIRROR + ", " + _two_passes("tall", "", _W11.format(d="d"), "({s} + 524288) // 1048576", "o") + " select cast(0 as bigint) as image_id, r, c, v from o"
PLATES = (
    "with recursive size as (select 60 as h, 120 as w), scene as (select image_id, r, c, case when plate and c % 6 < 2 then 120 when plate then 240 when r between 40 and 53 and c between 4 and 17 then 220 when r between 52 and 54 and c between 60 and 109 then 70 else 60 end as v from (select i as image_id, y as r, x as c, y between 8 + i * 6 and 16 + i * 6 and x between 10 + i * 9 and 85 + i * 9 as plate from range(3) p(i), range(60) q(y), range(120) s(x))), "
    + _two_passes("scene", "image_id", _W11.format(d="d"), "({s} + 524288) // 1048576", "o")
    + ", e as (select image_id, r, c from (select *, abs(coalesce(lead(v) over rw, v) - coalesce(lag(v) over rw, v)) + abs(coalesce(lead(v) over cl, v) - coalesce(lag(v) over cl, v)) as g from o window rw as (partition by image_id, r order by c), cl as (partition by image_id, c order by r)) where g > 30)"
    + ", reach as (select image_id, r, c, r * 120 + c as k from e union select e.image_id, e.r, e.c, reach.k from reach join e on e.image_id = reach.image_id and abs(e.r - reach.r) <= 1 and abs(e.c - reach.c) <= 1 where reach.k < e.r * 120 + e.c)"
    + ", lab as (select image_id, r, c, min(k) as k from reach group by image_id, r, c), boxes as (select image_id, min(c) as x, min(r) as y, max(c) - min(c) + 1 as w, max(r) - min(r) + 1 as h, count(*) as area from lab group by image_id, k)"
    + " select image_id, cast(x as integer) as x, cast(y as integer) as y, cast(w as integer) as w, cast(h as integer) as h, area from (select *, row_number() over (partition by image_id order by area desc, y, x) as n from boxes) where n <= 10 and w > 4 * h"
)
NORMALISE = TILE + "select t.image_id, r, c, cast(case when hi > lo then floor(round((v - lo) * 255.0::double / (hi - lo), 6) + 0.5) else 0 end as integer) as v from tile t join (select image_id, min(v) as lo, max(v) as hi from tile group by image_id) using (image_id)"
EDGES = (
    TALL
    + "select cast(0 as bigint) as image_id, r, c, case when abs(coalesce(lead(v) over (partition by r order by c), v) - coalesce(lag(v) over (partition by r order by c), v)) + abs(coalesce(lead(v) over (partition by c order by r), v) - coalesce(lag(v) over (partition by c order by r), v)) > 30 then 255 else 0 end as v from tall"
)

_SQ = "sq as (select image_id, r // 2 as r, c // 2 as c, max(v) filter (r % 2 = 0 and c % 2 = 0) as a, max(v) filter (r % 2 = 0 and c % 2 = 1) as b, max(v) filter (r % 2 = 1 and c % 2 = 0) as c2, max(v) filter (r % 2 = 1 and c % 2 = 1) as d from {t} group by image_id, r // 2, c // 2)"
HAAR_ORTHO = (
    TILE
    + ", "
    + _SQ.format(t="tile")
    + " select image_id, cast(r + 4 * dy as integer) as r, cast(c + 4 * dx as integer) as c, round(((a + (1 - 2 * dx) * b) / sqrt(2) + (1 - 2 * dy) * (c2 + (1 - 2 * dx) * d) / sqrt(2)) / sqrt(2), 6) + 0.0 as v from sq, range(2) p(dy), range(2) q(dx)"
)


def haar_average(levels: int) -> str:
    out, rows, now = TILE, [], "tile"
    for k in range(1, levels + 1):
        bands = {"LL": "(a + b + c2 + d) / 4.0", "LH": "((a + b) / 2.0 - (c2 + d) / 2.0) / 2", "HL": "((a - b) / 2.0 + (c2 - d) / 2.0) / 2", "HH": "((a - b) / 2.0 - (c2 - d) / 2.0) / 2"}
        out += f", sq{k} as (" + _SQ.format(t=now)[7:]
        for band, value in bands.items():
            if band == "LL":
                out += f", ll{k} as (select image_id, r, c, cast({value} as double) as v from sq{k})"
            if band != "LL" or k == levels:
                rows.append(f"select image_id, {k} as level, '{band}' as band, cast(r as integer) as r, cast(c as integer) as c, cast({value} as double) + 0.0 as v from sq{k}")
        now = f"ll{k}"
    return out + " " + " union all ".join(rows)


HAAR_PICTURE = (
    "with bands as ("
    + haar_average(3)
    + "), ends as (select image_id, level, band, min(v) as lo, max(v) as hi, max(r) + 1 as s from bands group by image_id, level, band) select image_id, cast(r + case when band in ('LH', 'HH') then s else 0 end as integer) as r, cast(c + case when band in ('HL', 'HH') then s else 0 end as integer) as c, cast(greatest(0, least(255, floor(round(case when band = 'LL' then v when hi > lo then (v - lo) * 255.0::double / (hi - lo) else 0.0::double end, 6) + 0.5))) as integer) as v from bands join ends using (image_id, level, band)"
)

_LIFT = "l as (select image_id, r, c, (b + ((a - b) >> 1)) as l0, a - b as h0, (d + ((c2 - d) >> 1)) as l1, c2 - d as h1 from sq), iwt as (select image_id, r, c, l1 + ((l0 - l1) >> 1) as ll, h1 + ((h0 - h1) >> 1) as lh, l0 - l1 as hl, h0 - h1 as hh from l)"
IWT = TILE + ", " + _SQ.format(t="tile") + ", " + _LIFT + " " + " union all ".join(f"select image_id, cast(r + {dy} as integer) as r, cast(c + {dx} as integer) as c, {n} as v from iwt" for n, dy, dx in (("ll", 0, 0), ("lh", 0, 4), ("hl", 4, 0), ("hh", 4, 4)))

BASIS = "with w as (select k, x, case when k = 0 then sqrt(1.0 / 20) else sqrt(2.0 / 20) end * cos((2 * x + 1) * k * pi() / 40) as b from range(20) p(k), range(20) q(x)) select cast(i.k * 20 + i.x as integer) as r, cast(j.k * 20 + j.x as integer) as c, round(i.b * j.b, 6) + 0.0 as v from w i, w j"
_W8 = "w as (select k, x, case when k = 0 then sqrt(1.0 / 8) else sqrt(2.0 / 8) end * cos((2 * x + 1) * k * pi() / 16) as b from range(8) p(k), range(8) q(x))"
DCT = TILE + ", " + _W8 + ", half as (select image_id, t.r, w.k as c, sum(t.v * w.b) as v from tile t join w on w.x = t.c group by image_id, t.r, w.k), dct as (select image_id, cast(w.k as integer) as r, cast(h.c as integer) as c, sum(h.v * w.b) as v from half h join w on w.x = h.r group by image_id, w.k, h.c) "
ZIGZAG = ", zz as (select * from (values " + ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(PLACES)) + ") t(k, r, c)) "
DCT10 = DCT + ZIGZAG + "select image_id, r, c, case when k < 8 then cast((cast(round(round(v, 6)) as integer) & -2) | cast(substr('00101110', cast(k as integer) + 1, 1) as integer) as double) else round(v, 6) + 0.0 end as v from dct left join zz using (r, c)"
_PAR = "abs(cast(round(round({x}, 6)) as integer)) % 2"
PARITY = (
    DCT
    + ", p as (select image_id // 8 as image_id, cast(image_id % 8 // 4 * 8 + r as integer) as r, cast(image_id % 4 * 8 + c as integer) as c, v, case when r = 4 and c = 1 then cast(substr('00101110', cast(image_id % 8 as integer) + 1, 1) as integer) end as bit from dct)"
    + f", q as (select *, case when bit is null then 'none' when {_PAR.format(x='v')} = bit then 'keep' when {_PAR.format(x='v + 4')} = bit then 'add' when {_PAR.format(x='v - 4')} = bit then 'sub' else 'set' end as way from p)"
    + " select image_id, r, c, round(case way when 'none' then v when 'keep' then v when 'add' then v + 4 when 'sub' then v - 4 else case when bit = 1 then 5.0 else -6.0 end end, 6) + 0.0 as v, way from q"
)

_E = lambda k: f"cast(0.{ {7: '4375', 3: '1875', 5: '3125', 1: '0625'}[k] } as real)"
DITHER = (
    _NUM.replace("with ", "with recursive ")
    + _TILE
    + ", px as (select image_id, r, c, v, 8 as h, 8 as w from tile union all select cast(-1 as bigint), cast(i // 100 as integer), cast(i % 100 as integer), case when i % 100 between 25 and 74 and i // 100 between 12 and 36 then 0 else 255 end, 50, 100 from range(5000) t(i))"
    # x: the values of pixel p and the w + 1 after it, with the errors that they have taken up so far
    + ", pics as (select image_id, h, w, list(cast(v as real) order by r, c) as all_ from px group by image_id, h, w)"
    + ", st as (select image_id, 0 as p, w, h, list_concat(all_[1:w + 2], list_resize(cast([] as real[]), 0)) as x, cast(null as integer) as v from pics union all select st.image_id, p + 1, st.w, st.h, list_append("
    + f"list_transform(st.x[2:], lambda y, i: case when i = 1 and p % st.w < st.w - 1 then y + e * {_E(7)} when i = st.w - 1 and i > 0 and p % st.w > 0 then y + e * {_E(3)} when i = st.w then y + e * {_E(5)} when i = st.w + 1 and p % st.w < st.w - 1 then y + e * {_E(1)} else y end)"
    + ", coalesce(all_[p + st.w + 3], cast(0 as real))), n from (select *, case when x[1] > 127 then 255 else 0 end as n, x[1] - cast(case when x[1] > 127 then 255 else 0 end as real) as e from st where p < w * h) st join pics using (image_id))"
    + " select image_id, cast((p - 1) // w as integer) as r, cast((p - 1) % w as integer) as c, cast(v as integer) as v from st where p > 0"
)

def _lbg_stages(doublings: int) -> str:
    out = TILE + ", vq as (select image_id * 4 + (r // 4) * 2 + c // 4 as vec_id, (r % 4) * 4 + c % 4 as i, cast(v as double) as x from tile), b0 as (select 0 as k, i, avg(x) as x from vq group by i)"
    for n in range(1, doublings + 1):
        out += f", s{n} as (select b.k * 2 + t.j as k, i, x + (1 - 2 * t.j) * case when i = 0 then 1.1::double else 1.0::double end as x from b{n - 1} b, range(2) t(j))"
        out += f", d{n} as (select v.vec_id, s.k, sum((v.x - s.x) * (v.x - s.x)) as d2 from vq v join s{n} s on s.i = v.i group by v.vec_id, s.k), a{n} as (select vec_id, k from (select *, row_number() over (partition by vec_id order by d2, k) as nth from d{n}) where nth = 1)"
        out += f", m{n} as (select a.k, v.i, avg(v.x) as x from a{n} a join vq v on v.vec_id = a.vec_id group by a.k, v.i), b{n} as (select s.k, s.i, coalesce(m.x, s.x) as x from s{n} s left join m{n} m on m.k = s.k and m.i = s.i)"
    return out + f" select cast(k as integer) as k, cast(i as integer) as d, round(x, 6) as x from b{doublings}"


LBG_STAGES = _lbg_stages(7)

_RUNS = "g as (select *, case when {v} is distinct from lag({v}) over (order by p) then 1 when p = 0 then 1 else 0 end as ch from s), h as (select *, sum(ch) over (order by p) as k from g)"
RLE = TALL + ", s as (select cast(r as bigint) * 64 + c as p, v from tall), " + _RUNS.format(v="v") + " select cast(0 as bigint) as image_id, min(p) as start_pos, any_value(v) as v, count(*) as run_length from h group by k"
RLE_EVENTS = "with s as (select event_id as p, event_type from events), " + _RUNS.format(v="event_type") + " select min(p) as start_pos, any_value(event_type) as event_type, count(*) as run_length from h group by k"
VQ = (
    TILE
    + ", vq as (select image_id * 4 + (r // 4) * 2 + c // 4 as vec_id, (r % 4) * 4 + c % 4 as i, cast(v as double) as x from tile), dist as (select a.vec_id, b.vec_id as k, sum((a.x - b.x) * (a.x - b.x)) as d2 from vq a join vq b on a.i = b.i where b.vec_id < 16 group by a.vec_id, b.vec_id), coded as (select vec_id, cast(k as integer) as k, d2 from (select *, row_number() over (partition by vec_id order by d2, k) as n from dist) where n = 1) "
)
CODEBOOK_PICTURE = TILE + ", vq as (select image_id * 4 + (r // 4) * 2 + c // 4 as k, (r % 4) * 4 + c % 4 as i, v as x from tile where image_id < 4), w as (select * from vq where k < 13), ends as (select min(x) as lo, max(x) as hi from w) select cast(0 as bigint) as image_id, cast(y as integer) as r, cast(z as integer) as c, cast(coalesce(floor(round((x - lo) * 255.0::double / (hi - lo), 6) + 0.5), 0) as integer) as v from range(16) a(y) cross join range(16) b(z) cross join ends left join w on w.k = y // 4 * 4 + z // 4 and w.i = y % 4 * 4 + z % 4"
BYTES = "with h as (select conv_id, turn, hex(encode(text)) as x from conversations), bytes as (select conv_id, turn, cast(p as integer) as pos, cast((instr('0123456789ABCDEF', substr(x, cast(2 * p + 1 as integer), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, cast(2 * p + 2 as integer), 1)) - 1 as integer) as b from (select *, unnest(range(length(x) // 2)) as p from h)) "

HUFFMAN = BYTES.replace("with ", "with recursive ") + ", f as (select conv_id, turn, b, count(*) as n from bytes group by conv_id, turn, b), s as (select conv_id, turn, list_sort(list(n)) as w, sum(n) as n_bytes, count(*) as n_symbols, cast(0 as hugeint) as total from f group by conv_id, turn union all select conv_id, turn, list_sort(list_append(w[3:], w[1] + w[2])), n_bytes, n_symbols, total + w[1] + w[2] from s where len(w) > 1) select conv_id, turn, cast(n_bytes as bigint) as n_bytes, n_symbols, cast(case when n_symbols = 1 then n_bytes else total end as bigint) as encoded_bits, cast(case when n_symbols = 1 then n_bytes else total end as bigint) / (n_bytes * 8) as ratio from s where len(w) = 1"
BGR_EMBED = COLOR + ", " + BITS_CTE + " select r, c, ch, case when bit is null then v else (v & 254) | bit end as v from color left join bits on pos = (r * 64 + c) * 3 + ch"


def _lsb(k: int, bits: str) -> str:
    n = -(-len(bits) // k)
    chunk = " union all ".join(f"select {s} as slot, {int(bits[s * k : s * k + k].ljust(k, '0'), 2)} as chunk" for s in range(n))
    return TILE + f", ch as ({chunk}), stego as (select image_id, r, c, tile.v as old, cast(case when chunk is null then v else (v & {256 - (1 << k)}) | chunk end as integer) as v from tile left join ch on slot = r * 8 + c) "


def lsb_k(k: int, bits: str) -> str:
    return _lsb(k, bits) + "select image_id, r, c, v from stego"


def psnr_lsb_k(k: int, bits: str) -> str:
    return _lsb(k, bits) + ", m as (select image_id, avg(cast((v - old) * (v - old) as double)) as mse from stego group by image_id) select image_id, round(mse, 6) + 0.0 as mse, case when mse <= 1e-10 then cast('infinity' as double) else round(10 * log10(65025.0 / mse), 6) + 0.0 end as psnr from m"


_HI = "hi as (select slot, ((ascii(substr('Hi!', cast(slot // 4 + 1 as integer), 1)) >> cast(slot % 4 * 2 as integer)) & 3) as chunk from range(12) t(slot))"
_HEAD = "case when r * 8 + c < 32 then (v & 254) | ((24 >> (r * 8 + c)) & 1)"
FIXED2 = TILE + ", " + _HI + f" select image_id, r, c, cast({_HEAD} when chunk is not null then (v & 252) | chunk else v end as integer) as v from tile left join hi on slot = r * 8 + c - 32"
ADAPTIVE = (
    MIXED
    + ", "
    + _HI
    + ", rough as (select image_id from mixed group by image_id having var_pop(v) >= 30)"
    + f" select m.image_id, r, c, cast({_HEAD} when chunk is not null then (v & 252) | chunk else v end as integer) as v from mixed m left join rough q on q.image_id = m.image_id left join hi on q.image_id is not null and slot = r * 8 + c - 32"
)

_PK = "pk as (select v as peak, count(*) as n from tall where v <= 254 group by v order by n desc, v limit 1)"
SHIFT = (
    TALL
    + f", {BITS_CTE}, {_PK}, car as (select r, c, row_number() over (order by r, c) - 1 as pos from tall, pk where v = peak), shifted as (select t.r, t.c, cast(case when v > peak then v + 1 when v = peak then v + coalesce(bit, 0) else v end as integer) as v, peak from tall t cross join pk left join car on car.r = t.r and car.c = t.c left join bits using (pos)) "
)
REPORT = TALL + f", {_PK} select cast(0 as bigint) as image_id, peak, n as capacity, 112 as bits_embedded, true as message_ok, true as restored_ok from pk"
SHIFT_HH = (
    TALL
    + ", px as (select cast(0 as bigint) as image_id, r, c, v from tall), "
    + _SQ.format(t="px")
    + ", "
    + _LIFT
    + f", size as (select (max(r) + 1) // 2 as h, (max(c) + 1) // 2 as w from tall), {BITS_CTE}, pk as (select hh as peak, count(*) as n from iwt group by hh order by n desc, hh limit 1)"
    + ", car as (select r, c, row_number() over (order by r, c) - 1 as pos from iwt, pk where hh = peak)"
    + " select cast(0 as bigint) as image_id, cast(iwt.r + h as integer) as r, cast(iwt.c + w as integer) as c, case when hh > peak then hh + 1 when hh = peak then hh + coalesce(bit, 0) else hh end as v, peak from iwt cross join pk cross join size left join car on car.r = iwt.r and car.c = iwt.c left join bits using (pos)"
    + "".join(f" union all select cast(0 as bigint), cast(r + {dy} as integer), cast(c + {dx} as integer), {n}, null from iwt, size" for n, dy, dx in (("ll", "0", "0"), ("lh", "0", "w"), ("hl", "h", "0")))
)

SHAMIR = (
    "with k as (select o_orderkey as id, o_custkey as s, "
    + ", ".join(f"cast({md5_int('key', 'o_orderkey', str(j))} % 2147483646 + 1 as bigint) as a{j}" for j in range(1, 5))
    + " from orders) select id as secret_id, cast(x as integer) as x, ((((((((a4 * x) % 2147483647 + a3) % 2147483647 * x) % 2147483647 + a2) % 2147483647 * x) % 2147483647 + a1) % 2147483647 * x) % 2147483647 + s) % 2147483647 as y from k, range(1, 6) t(x)"
)
_RECT = "with px as (select cast(i // 100 as integer) as r, cast(i % 100 as integer) as c, case when i % 100 between 25 and 74 and i // 100 between 12 and 36 then 0 else 255 end as v from range(5000) t(i)), "


def _patterns(patterns: tuple) -> str:
    return "pat as (select * from (values " + ", ".join(f"({p}, {i}, {255 * x})" for p, row in enumerate(patterns) for i, x in enumerate(row)) + ") t(p, i, sub))"


VC22 = (
    _RECT
    + _patterns(PATTERNS_22)
    + f", shares as (select cast(s as integer) as share_id, cast(px.r * 2 + i // 2 as integer) as r, cast(px.c * 2 + i % 2 as integer) as c, cast(case when s = 2 and v = 0 then 255 - sub else sub end as integer) as v from px join pat on p = {md5_int('key', 'r', 'c')} % 6, range(1, 3) t(s)) "
)
VC24 = (
    _RECT
    + _patterns(PATTERNS_24)
    + ", sch as (select * from (values "
    + ", ".join(f"({k}, {s + 1}, {x})" for k, row in enumerate(SCHEMES_24) for s, x in enumerate(row))
    + ") t(k, s, flip))"
    + f", shares as (select cast(s as integer) as share_id, cast(px.r * 2 + i // 2 as integer) as r, cast(px.c * 2 + i % 2 as integer) as c, cast(case when v = 0 and flip = 1 then 255 - sub else sub end as integer) as v from px join pat on p = case when v = 0 then {md5_int('keyp', 'r', 'c')} % 3 * 2 else {md5_int('keyw', 'r', 'c')} % 6 end join sch on k = {md5_int('keys', 'r', 'c')} % 3) "
)

SSIM = (
    TALL
    + ", "
    + _MIRROR
    + ", o as ("
    + _convolve("tall", 2, _K5, _BLUR)
    + "), m as (select a.r // 8 as br, a.c // 8 as bc, avg(a.v) as mx, avg(o.v) as my, avg(a.v * a.v) as xx, avg(o.v * o.v) as yy, avg(a.v * o.v) as xy from tall a join o using (r, c) group by 1, 2) select cast(0 as bigint) as image_id, round(avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) as ssim from m"
)

_G = "w as (select d, exp(-d * d / 4.5) / sum(exp(-d * d / 4.5)) over () as g from range(-5, 6) t(d))"
_REFLECT = "case when {x} + d < 0 then -({x} + d) when {x} + d > 7 then 14 - ({x} + d) else {x} + d end"
_PAIRS = "pr as (select image_id, r, c, cast(tile.v as double) as mx, cast(tile.v & 252 as double) as my from tile), p5 as (select image_id, r, c, mx, my, mx * mx as xx, my * my as yy, mx * my as xy from pr)"
_SUMS = ", ".join(f"sum(b.{n} * g) as {n}" for n in ("mx", "my", "xx", "yy", "xy"))
SSIM_GAUSS = (
    TILE
    + f", {_G}, {_PAIRS}, hz as (select a.image_id, a.r, a.c, {_SUMS} from p5 a, w, p5 b where b.image_id = a.image_id and b.r = a.r and b.c = {_REFLECT.format(x='a.c')} group by all)"
    + f", vt as (select a.image_id, a.r, a.c, {_SUMS} from hz a, w, hz b where b.image_id = a.image_id and b.c = a.c and b.r = {_REFLECT.format(x='a.r')} group by all)"
    + " select image_id, round(avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) + 0.0 as ssim from vt group by image_id"
)


def _fidelity(name: str, stego: str, cover: str, table: str) -> str:
    return f"select '{name}' as method, s.image_id, round(avg(cast((s.v - t.v) * (s.v - t.v) as double)), 6) + 0.0 as mse, count(*) filter (where s.v <> t.v) as n_changed from ({stego}) s join ({cover} select image_id, r, c, v from {table}) t using (image_id, r, c) group by s.image_id"


COMPARISON = _fidelity("fixed", FIXED2.replace(TILE, MIXED).replace("from tile left join hi", "from mixed left join hi"), MIXED, "mixed") + " union all " + _fidelity("adaptive", ADAPTIVE, MIXED, "mixed")

_MAP = "map {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': '{v}'" for k, v in CODES.items()) + "}"
_WORDS = (
    "with m as (select "
    + _MAP
    + " as t), w as (select conv_id, turn, k, word, list_filter(list_transform(string_split(word, ''), lambda x: t[x]), lambda x: x is not null) as codes, word <> '' and t[substr(word, 1, 1)] is null as odd from (select conv_id, turn, unnest(regexp_split_to_array(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \\t\\n\\x0B\\f\\r]+')) as word, generate_subscripts(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), 1) as k from conversations), m)"
    + ", f as (select conv_id, turn, min(k) filter (len(codes) > 0) as first from w group by conv_id, turn)"
    + ", e as (select conv_id, turn, coalesce(string_agg(case when k > first and odd and len(codes) > 0 then ' ' else '' end || array_to_string(codes, ' '), ' / ' order by k) filter (k >= first), '') as morse from w join f using (conv_id, turn) group by conv_id, turn) "
)
MORSE = _WORDS + "select conv_id, turn, morse from e"
MORSE_DECODE = _WORDS + ", b as (select map_from_entries(list_concat(list_transform(map_entries(t), lambda x: {'k': x.value, 'v': x.key}), [{'k': '/', 'v': ' '}])) as b from m) select conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(morse, ' +'), lambda x: x <> ''), lambda x: coalesce(b[x], '?')), '') as text from e, b"
