"""SQL for the named queries of the core: the same rows from the definitions, without the library's operators."""

from __future__ import annotations

from kvlake.functions import codebook, layouts
from kvlake.functions import text as T


def _num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _f16(x: str) -> str:
    return f"(CASE WHEN abs({x}) >= 65520 THEN sign({x}) * 'inf'::DOUBLE WHEN abs({x}) < power(2e0, -14) THEN round_even({x} * 16777216e0, 0) / 16777216e0 ELSE {x} * 4398046511105e0 - ({x} * 4398046511105e0 - {x}) END)"


def _hex16(x: str) -> str:
    """The bytes, as hexadecimal digits, of a value that half precision holds."""
    top = f"floor(log2(abs({x})))"
    bits = f"(CASE WHEN {x} = 0 THEN 0 ELSE ({x} < 0)::INT * 32768 + CASE WHEN abs({x}) < power(2e0, -14) THEN (abs({x}) * 16777216e0)::INT ELSE ({top} + 15)::INT * 1024 + ((abs({x}) / power(2e0, {top}) - 1) * 1024)::INT END END)"
    return f"printf('%02x%02x', {bits} & 255, {bits} >> 8)"


def _code(z: str, levels: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"({z} > {_num(m)})::INT" for m in codebook.midpoints(levels)) + ")"


def _level(c: str, levels: tuple[float, ...]) -> str:
    return "([" + ", ".join(map(_num, levels)) + f"])[{c} + 1]"


_KV = f"""
kv AS (SELECT (vec_id // 50)::VARCHAR AS doc_id, (vec_id % 2)::INT AS head, ((vec_id % 50) // 2)::INT AS token, embedding AS k, list_reverse(embedding) AS v FROM embeddings),
raw AS (SELECT doc_id, head, token, 'k' AS part, unnest(k)::DOUBLE AS x0, generate_subscripts(k, 1) - 1 AS i FROM kv
        UNION ALL SELECT doc_id, head, token, 'v', unnest(v)::DOUBLE, generate_subscripts(v, 1) - 1 FROM kv),
el AS (SELECT *, {_f16("x0")} AS x FROM raw)"""


def _rot(head: str, name: str = "rot") -> str:
    return f"{name} AS (SELECT doc_id, head, token, part, j, sum(CASE WHEN (bit_count(i & j) + i + {head}) % 2 = 0 THEN x ELSE -x END) / 8 AS y FROM el, range(64) r(j) GROUP BY ALL)"


_Z = """
rms AS (SELECT doc_id, head, token, part, greatest(sqrt(sum(y * y) / 64), 1e-8) AS s FROM rot GROUP BY ALL),
z AS (SELECT rot.*, s, y / s AS z FROM rot JOIN rms USING (doc_id, head, token, part))"""

_C16 = f"c16 AS (SELECT *, {_code('z', codebook.LEVELS16)} AS c FROM z)"
_C8 = f"""
c8a AS (SELECT *, greatest(least(z, 2.5e0), -2.5e0) AS zk FROM z WHERE part = 'k'),
c8b AS (SELECT *, {_code("zk", codebook.LEVELS8)} AS c FROM c8a),
c8e AS (SELECT *, zk - {_level("c", codebook.LEVELS8)} AS e FROM c8b),
res AS (SELECT doc_id, head, token, greatest(sqrt(sum(e * e) / 64), 1e-8) AS re FROM c8e GROUP BY ALL),
c8 AS (SELECT c8e.*, re, (e >= 0)::INT AS bit FROM c8e JOIN res USING (doc_id, head, token))"""
_ABS = """
amax AS (SELECT doc_id, head, token, part, greatest(max(abs(x)) / 7, 1e-8) AS s FROM el GROUP BY ALL),
ab AS (SELECT el.*, i AS j, s, greatest(least(round_even(x / s, 0), 7), -8) AS q FROM el JOIN amax USING (doc_id, head, token, part))"""
_BITS = "sb AS (SELECT *, (z >= 0)::INT AS bit FROM z WHERE part = 'k')"

_NIBBLES = "string_agg(printf('%x', {}), '' ORDER BY (j // 2) * 2 + 1 - j % 2)"
_FIXED = "({} * 134217728)::BIGINT"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def _codes(name: str) -> str:
    key = "doc_id, head, token"
    scale = lambda c="any_value(s)": _FIXED.format(_f16(f"({c})"))
    v16 = f"v AS (SELECT {key}, {_NIBBLES.format('c')} AS v_hex, {scale()} AS v_scale FROM c16 WHERE part = 'v' GROUP BY ALL)"
    none = "(-1)::BIGINT AS k_residual"
    if name == "mse4":
        k = f"k AS (SELECT {key}, {_NIBBLES.format('c')} AS k_hex, {scale()} AS k_scale, {none} FROM c16 WHERE part = 'k' GROUP BY ALL)"
        head = _with(_KV, _rot("head"), _Z, _C16, k, v16)
    elif name == "prod4":
        k = f"k AS (SELECT {key}, {_NIBBLES.format('c + 8 * bit')} AS k_hex, {scale()} AS k_scale, {scale('any_value(re)')} AS k_residual FROM c8 GROUP BY ALL)"
        head = _with(_KV, _rot("head"), _Z, _C16, _C8, k, v16)
    elif name == "sign1":
        k = f"""kb AS (SELECT {key}, j // 8 AS b, sum(bit << (j % 8)::INT)::INT AS byte, any_value(s) AS s FROM sb GROUP BY ALL),
k AS (SELECT {key}, string_agg(printf('%02x', byte), '' ORDER BY b) AS k_hex, {scale()} AS k_scale, {none} FROM kb GROUP BY ALL)"""
        head = _with(_KV, _rot("0"), _Z, _C16, _BITS, k, v16)
    elif name == "absmax4":
        side = lambda p: f"{p} AS (SELECT {key}, {_NIBBLES.format('((q + 16) % 16)::INT')} AS {p}_hex, {scale()} AS {p}_scale{', ' + none if p == 'k' else ''} FROM ab WHERE part = '{p}' GROUP BY ALL)"
        head = _with(_KV, _ABS, side("k"), side("v"))
    return head + f"SELECT {key}, k_hex, v_hex, k_scale, k_residual, v_scale FROM k JOIN v USING (doc_id, head, token)"


#: Per scheme, the steps up to `dec` (doc_id, head, token, part, j, y): what codes stand for in the domain they are kept in.
_16 = f"SELECT doc_id, head, token, part, j, {_level('c', codebook.LEVELS16)} * {_f16('s')} AS y FROM c16"
_DECODED = {
    "dense16": [_KV, "dec AS (SELECT doc_id, head, token, part, i AS j, x AS y FROM el)"],
    "absmax4": [_KV, _ABS, f"dec AS (SELECT doc_id, head, token, part, j, q * {_f16('s')} AS y FROM ab)"],
    "mse4": [_KV, _rot("head"), _Z, _C16, f"dec AS ({_16})"],
    "prod4": [_KV, _rot("head"), _Z, _C16, _C8, f"dec AS (SELECT doc_id, head, token, part, j, ({_level('c', codebook.LEVELS8)} + {_f16('re')} * (2 * bit - 1)) * {_f16('s')} AS y FROM c8 UNION ALL {_16} WHERE part = 'v')"],
    "sign1": [_KV, _rot("0"), _Z, _C16, _BITS, f"dec AS (SELECT doc_id, head, token, part, j, (2 * bit - 1) * {_f16('s')} AS y FROM sb UNION ALL {_16} WHERE part = 'v')"],
}
_TURNED = {"dense16": None, "absmax4": None, "mse4": "head", "prod4": "head", "sign1": "0"}


def _back(source: str, keys: str, head: str | None, out: str) -> str:
    """`out` (keys, i, x): the values of `source` (keys, j, y) turned back and rounded."""
    if head is None:
        return f"{out} AS (SELECT {keys}, j AS i, {_f16('y')} AS x FROM {source})"
    return f"{out}0 AS (SELECT {keys}, i, sum(CASE WHEN (bit_count(i & j) + i + {head}) % 2 = 0 THEN y ELSE -y END) / 8 AS x FROM {source}, range(64) r(i) GROUP BY ALL), {out} AS (SELECT * EXCLUDE x, {_f16('x')} AS x FROM {out}0)"


def _roundtrip(name: str) -> str:
    steps = [*_DECODED[name], _back("dec", "doc_id, head, token, part", _TURNED[name], "got")]
    both = "SELECT raw.part, x0 AS a, got.x AS b FROM raw JOIN got USING (doc_id, head, token, part, i)"
    return f"(WITH {', '.join(steps)} SELECT '{name}' AS scheme, part, round(avg((a - b) * (a - b)), 6) AS mse, round(max(abs(a - b)), 6) AS max_abs, round(avg((a - b) * (a - b)) / (var_samp(a) + 1e-8), 6) AS rel_mse FROM ({both}) GROUP BY part)"


_DOCS = "docs AS (SELECT max(vec_id) // 50 + 1 AS n FROM embeddings)"
_ASK = "((doc_id::BIGINT - 1 + n) % n)::VARCHAR AS doc_id, 'q' || doc_id AS q_id, head"


def _attended(name: str) -> list[str]:
    """Steps up to `out` (q_id, doc_id, head, j, y) on what codes stand for, before it is turned back."""
    turned = _TURNED[name]
    plain = "SELECT doc_id, head, token, part, i AS j, x AS y FROM el" if turned is None else "SELECT doc_id, head, token, part, j, y FROM rot"
    return [
        *_DECODED[name], _DOCS,
        f"asked AS (SELECT {_ASK}, j, y AS q FROM ({plain}) s, docs WHERE part = 'k' AND token = 0)",
        f"logit AS (SELECT q_id, doc_id, head, token, sum(q * y){'' if name == 'sign1' else ' / 8'} AS logit FROM asked JOIN dec USING (doc_id, head, j) WHERE part = 'k' GROUP BY ALL)",
        "weight AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY q_id, doc_id, head)) AS w FROM logit)",
        "out AS (SELECT q_id, doc_id, head, j, sum(w * y) / sum(w) AS y FROM weight JOIN dec USING (doc_id, head, token) WHERE part = 'v' GROUP BY ALL)",
    ]


def _fused(name: str) -> str:
    steps = [*_attended(name), _back("out", "q_id, doc_id, head", _TURNED[name], "got")]
    return f"WITH {', '.join(steps)} SELECT q_id, doc_id, head, i AS j, round(x, 5) AS out FROM got"


def _plain_steps() -> list[str]:
    return [
        _KV, _DOCS,
        f"asked AS (SELECT {_ASK}, i, x AS q FROM el, docs WHERE part = 'k' AND token = 0)",
        "logit AS (SELECT q_id, doc_id, head, token, sum(q * x) / 8 AS logit FROM asked JOIN el USING (doc_id, head, i) WHERE part = 'k' GROUP BY ALL)",
        "weight AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY q_id, doc_id, head)) AS w FROM logit)",
        "plain AS (SELECT q_id, doc_id, head, i, sum(w * x) / sum(w) AS out FROM weight JOIN el USING (doc_id, head, token) WHERE part = 'v' GROUP BY ALL)",
    ]


def _attn_mse(name: str, by: str = "") -> str:
    steps = [*_attended(name), _back("out", "q_id, doc_id, head", _TURNED[name], "got")]
    fused = f"WITH {', '.join(steps)} SELECT q_id, doc_id, head, i, x FROM got"
    plain = f"WITH {', '.join(_plain_steps())} SELECT q_id, doc_id, head, i, out FROM plain"
    return f"(SELECT '{name}' AS scheme{by}, round(avg((x - out) * (x - out)), 8) AS mse FROM ({fused}) f JOIN ({plain}) p USING (q_id, doc_id, head, i) GROUP BY ALL)"


def _page_bytes() -> str:
    shapes = "(VALUES (16, 8, 128), (16, 2, 128), (16, 2, 64), (32, 4, 64)) s(block, heads, dim)"
    up = lambda x: f"((({x}) + 255) // 256 * 256)"
    c = "block * heads"
    four = "dim // 2"
    return f"""SELECT unnest(['dense16', 'absmax4', 'mse4', 'prod4', 'sign1']) AS scheme, block, heads, dim, unnest([
    2 * {up(f"{c} * dim * 2")}, 2 * ({up(f"{c} * {four}")}) + 2 * ({up(f"{c} * 2")}), 2 * ({up(f"{c} * {four}")}) + 2 * ({up(f"{c} * 2")}),
    {c} * ({four} + 2 + 2 + {four} + 2), {c} * ((dim + 7) // 8 + 2 + {four} + 2)])::BIGINT AS page_bytes FROM {shapes}"""


_PAGE = {s: layouts.page_bytes(s, layouts.Config().with_shape(2, 64)) for s in layouts.SCHEMES}

# ---------------------------------------------------------------- texts

#: RE2 forms of the classes that the texts' columns use.
_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SP}+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _normal(x: str) -> str:
    apart = r"regexp_replace(lower(" + x + r"), '([^\p{L}\p{N}_])', chr(1) || '\1' || chr(1), 'g')"
    bare = "regexp_replace(" + apart + r", '(^|\x01)(?:a|an|the)($|\x01)', '\1 \2', 'g')"
    plain = "regexp_replace(replace(" + bare + r", chr(1), ''), '[!-/:-@\[-`{-~]', ' ', 'g')"
    return f"array_to_string({_words(plain)}, ' ')"


def _stem(x: str) -> str:
    return "left(regexp_replace(" + x + r", '[^\p{L}\p{N}_-]', '_', 'g'), 64)"


def _f1() -> str:
    return f"""
WITH runs AS (SELECT DISTINCT run_id, doc_id, answer FROM run_result),
pairs AS (SELECT run_id, answer, unnest(answers) AS ref FROM runs LEFT JOIN eval_samples USING (doc_id)),
toks AS (SELECT run_id, {_words(_normal("coalesce(answer, '')"))} AS p, {_words(_normal("coalesce(ref, '')"))} AS r FROM pairs),
shared AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))) AS c FROM toks),
f AS (SELECT run_id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = 0 AND len(r) = 0)::INT::DOUBLE WHEN c = 0 THEN 0.0 ELSE 2 * (c / len(p)) * (c / len(r)) / (c / len(p) + c / len(r)) END AS f1 FROM shared),
best AS (SELECT run_id, max(f1) AS f1 FROM f GROUP BY run_id)
SELECT run_id, round(coalesce(f1, 0), 6) AS f1 FROM runs LEFT JOIN best USING (run_id)"""


def _latency(source: str, by: str, value: str) -> str:
    at = lambda q: f"list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))[least(floor(count({value}) * {q}e0), count({value}) - 1)::BIGINT + 1]"
    return f"SELECT {by}, count({value}) AS n, round(coalesce(avg({value}), 0), 6) AS avg, coalesce({at(0.5)}, 0) AS p50, coalesce({at(0.95)}, 0) AS p95 FROM {source} GROUP BY {by}"


def _lines(x: str) -> str:
    return "regexp_split_to_array(" + x + r", '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"


def _last(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda x: {_strip('x')}), lambda x: x <> '')[-1]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


def _other() -> str:
    paragraph = _last("string_split(prompt, chr(10) || chr(10))") + " || chr(10)"
    return f"coalesce({paragraph}, {_quoted(T.OTHER_PROMPT)})"


def _extract() -> str:
    asked = "'Question: ' || " + _strip("string_split(" + _strip("string_split(prompt, chr(10) || 'Question:')[-1]") + ", chr(10) || 'Answer:')[1]") + " || chr(10) || 'Answer:'"
    line = _last(_lines(_strip("prompt"))) + " || chr(10) || 'Answer:'"
    prompt = "context_text || chr(10) || 'Question: ' || query_prompt || chr(10) || 'Answer:'"
    return f"""
WITH p AS (SELECT doc_id, unnest(['qasper', 'hotpotqa', 'gov_report', 'other']) AS dataset, unnest([{prompt}, context_text, {prompt}, context_text]) AS prompt FROM eval_samples)
SELECT doc_id, dataset, CASE WHEN dataset IN ('qasper', 'hotpotqa') THEN CASE WHEN contains(prompt, chr(10) || 'Question:') THEN {asked} ELSE coalesce({line}, {_other()}) END
  WHEN dataset = 'gov_report' THEN {_quoted(T.SUMMARY_PROMPT)} ELSE {_other()} END AS asked FROM p"""


_PADDED = f"""
WITH s AS (SELECT doc_id, {_words("coalesce(context_text, '')")} AS w, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM eval_samples),
line AS (SELECT flatten(list(w ORDER BY i)) AS everything FROM s),
placed AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s),
whole AS (SELECT doc_id, w, list_concat(list_concat(w, list_slice(everything, start + len(w) + 1, len(everything))), list_slice(everything, 1, start + len(w))) AS all_ FROM placed, line),
cut AS (SELECT doc_id, list_slice(CASE WHEN len(all_) < 512 THEN flatten([all_, all_, all_, all_]) ELSE all_ END, 1, 512) AS w FROM whole)
SELECT doc_id, array_to_string(w, ' ') AS context_text, len(w)::INT AS context_tokens FROM cut"""

_DEDUPED = f"""
WITH c AS (SELECT seq, id, text, left(sha256(text), 16) AS hash, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM corpus WHERE {_strip("text")} <> ''),
named AS (SELECT CASE WHEN nth = 1 THEN id ELSE id || '_' || hash END AS id, text, seq, min(seq) OVER (PARTITION BY id, hash) AS place FROM c),
one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM named)"""

_CHUNKED = f"""
WITH w AS (SELECT doc_id AS seq, {_stem("source || '/' || doc_id::VARCHAR")} AS stem, {_words("text")} AS w FROM documents WHERE {_strip("text")} <> ''),
n AS (SELECT *, CASE WHEN len(w) <= 96 THEN 1 ELSE ceil((len(w) - 96) / 80)::INT + 1 END AS total FROM w),
k AS (SELECT *, unnest(range(total)) AS chunk FROM n)
SELECT seq, chunk::INT AS chunk, CASE WHEN total = 1 THEN stem ELSE stem || '_c' || printf('%03d', chunk) END AS id, array_to_string(list_slice(w, chunk * 80 + 1, chunk * 80 + 96), ' ') AS text FROM k"""

_RUNS = "(SELECT DISTINCT run_id, doc_id, scheme, answer, ttft_ms, kv_mb FROM run_result)"
_HIT = "len(list_filter(answers, lambda r: contains(lower(" + _strip("coalesce(answer, '')") + "), lower(" + _strip("r") + ")))) > 0"

# ---------------------------------------------------------------- slots and store

_APPENDS = """
WITH a AS (SELECT user_id AS seq_id, event_id AS "order", event_id * 7 % 40 + 1 AS n FROM events),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY seq_id ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM a),
b AS (SELECT *, start // 16 AS first_block, (start + n + 15) // 16 - (start + 15) // 16 AS new_blocks FROM t),
p AS (SELECT *, coalesce(sum(new_blocks) OVER (ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS taken FROM b),
phys AS (SELECT seq_id, (start + 15) // 16 + k AS logical, taken + k AS physical FROM (SELECT *, unnest(range(new_blocks)) AS k FROM p))"""

_ROWS = """
WITH e AS (SELECT store_name, unnest(map_entries(entries)) AS x FROM manifest),
l AS (SELECT store_name, x.key AS doc_id, x.value.sha256 AS sha256, unnest(map_entries(x.value.layers)) AS y FROM e),
r AS (SELECT store_name, doc_id, sha256, try_cast(string_split(y.key, '::')[1] AS INT) AS layer, string_split(y.key, '::')[2] AS scheme, y.value.key AS key, y.value.num_tokens AS num_tokens, y.value.stored_at AS stored_at FROM l)"""
_KEY = "left(sha256({0}), 16) || '_L' || printf('%02d', {1}) || '_' || {2}"

_P2 = """
WITH e AS (SELECT manifest_id, unnest(map_entries(entries)) AS x FROM manifest),
l AS (SELECT manifest_id, x.key AS doc_id, unnest(map_entries(x.value.layers)) AS y FROM e),
refs AS (
  SELECT e.manifest_id, x.key AS doc_id, '' AS layer_key, 'corpus' AS ref_table, x.key AS ref_key, list_min(list_transform(map_values(x.value.layers), lambda v: v.stored_at)) AS stored_at FROM e
  UNION ALL SELECT manifest_id, doc_id, y.key, 'layer_registry', y.key, y.value.stored_at FROM l
  UNION ALL SELECT manifest_id, doc_id, y.key, 'store_files', y.value.key, y.value.stored_at FROM l WHERE y.value.key IS NOT NULL),
parents AS (
  SELECT 'corpus' AS ref_table, id AS ref_key, loaded_at AS s, removed_at AS t FROM corpus
  UNION ALL SELECT 'layer_registry', layer_key, added_at, retired_at FROM layer_registry
  UNION ALL SELECT 'store_files', file_key, created_at, deleted_at FROM store_files),
keys AS (SELECT ref_table, ref_key, bool_or(t IS NULL) AS live, min(epoch_us(s)) FILTER (WHERE t IS NULL) / 1e6 AS live_from FROM parents GROUP BY 1, 2),
found AS (SELECT manifest_id, doc_id, layer_key, ref_table, stored_at,
    CASE WHEN k.ref_key IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN live_from > stored_at THEN 'late' END AS status
  FROM refs LEFT JOIN keys k USING (ref_table, ref_key))
"""

SQL = {
    **{f"codes_{n}": _codes(n) for n in ("absmax4", "mse4", "prod4", "sign1")},
    **{f"attn_fused_{n}": _fused(n) for n in layouts.SCHEMES},
    "wht_rotate": _with(_KV, _rot("head")) + f"SELECT doc_id, head, token, part, j, {_FIXED.format('y')} AS y FROM rot",
    "wht_unrotate": _with(_KV) + f"SELECT doc_id, head, token, part, i AS j, {_FIXED.format('x')} AS z FROM el",
    "rms_scale": _with(_KV, _rot("head"), _Z, _ABS) + f"SELECT r.doc_id, r.head, r.token, r.part, {_FIXED.format(_f16('r.s'))} AS rms, {_FIXED.format(_f16('a.s'))} AS absmax FROM rms r JOIN amax a USING (doc_id, head, token, part)",
    "pack_bits_hex": _with(_KV, _ABS) + f"""SELECT doc_id, head, token, hex1, hex2, hex4, true AS same1, true AS same2, true AS same4, sum4 FROM
      (SELECT doc_id, head, token, string_agg(printf('%02x', byte), '' ORDER BY b) AS hex1 FROM (SELECT doc_id, head, token, i // 8 AS b, sum((x >= 0)::INT << (i % 8)::INT)::INT AS byte FROM el WHERE part = 'k' GROUP BY ALL) GROUP BY ALL)
      JOIN (SELECT doc_id, head, token, string_agg(printf('%02x', byte), '' ORDER BY b) AS hex2 FROM (SELECT doc_id, head, token, i // 4 AS b, sum(((x >= 0)::INT + 2 * (i % 2)::INT) << (2 * (i % 4))::INT)::INT AS byte FROM el WHERE part = 'k' GROUP BY ALL) GROUP BY ALL) USING (doc_id, head, token)
      JOIN (SELECT doc_id, head, token, {_NIBBLES.format("((q + 16) % 16)::INT")} AS hex4, sum(q)::BIGINT AS sum4 FROM ab WHERE part = 'k' GROUP BY ALL) USING (doc_id, head, token)""",
    "roundtrip_error": " UNION ALL ".join(map(_roundtrip, layouts.SCHEMES)),
    "attn_sdpa": f"WITH {', '.join(_plain_steps())} SELECT q_id, doc_id, head, i AS j, round(out, 5) AS out FROM plain",
    "attn_logits_plain": f"WITH {', '.join(_plain_steps())} SELECT q_id, doc_id, head, token, round(logit, 6) AS logit FROM logit",
    "attn_logits_prod4": f"WITH {', '.join(_attended('prod4'))} SELECT q_id, doc_id, head, token, round(logit, 6) AS logit FROM logit",
    "attn_mse_by_scheme": " UNION ALL ".join(map(_attn_mse, layouts.SCHEMES)),
    "gqa_head_select": "SELECT (vec_id % 8 // 4)::INT AS head, vec_id FROM embeddings WHERE vec_id % 8 % 4 = 0",
    "layout_bytes": _page_bytes(),
    "compression_summary": f"""SELECT scheme, bytes::BIGINT AS bytes, round(32768 * 2 * 128 * 4 / bytes, 2) AS ratio FROM
      (SELECT scheme, CASE WHEN scheme = 'dense16' THEN 32768 * 2 * 128 * 4 ELSE 2048 * page_bytes END AS bytes FROM ({_page_bytes()}) WHERE block = 16 AND heads = 2 AND dim = 128)""",
    "kv_mb_by_doc_scheme": f"""WITH d AS (SELECT (vec_id // 50)::VARCHAR AS doc_id, max((vec_id % 50) // 2) + 1 AS tokens FROM embeddings GROUP BY 1)
      SELECT doc_id, scheme, 36 * CASE WHEN scheme = 'dense16' THEN tokens * 512 ELSE ceil(tokens / 16) * page_bytes END / 1048576 AS kv_mb FROM d, ({_page_bytes()}) WHERE block = 16 AND heads = 2 AND dim = 64""",
    "chunk_fixed": _CHUNKED,
    "doc_key": f"SELECT id, layer, {_KEY.format('id', 'layer', chr(39) + 'mse4' + chr(39))} AS key FROM (SELECT DISTINCT id FROM corpus), (VALUES (0), (7), (123)) l(layer)",
    "content_hash": "SELECT seq, left(sha256(text), 16) AS hash FROM corpus",
    "safe_stem": f"SELECT seq, {_stem('file_path')} AS stem FROM corpus",
    "dedupe_ids": _DEDUPED + "SELECT id, text FROM one WHERE nth = 1",
    "limited_corpus": _DEDUPED + "SELECT id, text FROM one WHERE nth = 1 ORDER BY place, length(id), id LIMIT 100",
    "token_f1": _f1(),
    "substring_accuracy": f"SELECT scheme, count(*) AS n, sum(({_HIT})::INT)::BIGINT AS hits FROM (SELECT DISTINCT run_id, doc_id, scheme, answer FROM run_result) JOIN eval_samples USING (doc_id) GROUP BY scheme",
    "normalise_answers": f"SELECT DISTINCT run_id, {_normal('answer')} AS normal FROM run_result",
    "extract_query": _extract(),
    "pad_contexts": _PADDED,
    "truncate_tokens": f"SELECT doc_id, array_to_string(list_slice({_words('context_text')}, 1, 50), ' ') AS context, 'Question: ' || query_prompt || chr(10) || 'Answer:' AS prompt FROM eval_samples",
    "latency_stats": _latency("events", "event_type", "value"),
    "run_latency_stats": _latency("(SELECT DISTINCT run_id, scheme, ttft_ms FROM run_result)", "scheme", "ttft_ms"),
    "scheme_report": f"""
WITH runs AS {_RUNS}, m AS (SELECT scheme, count(*) AS n, coalesce(avg(ttft_ms), 0) AS ttft_ms, coalesce(avg(kv_mb), 0) AS kv_mb FROM runs GROUP BY scheme),
f AS ({_f1().replace("round(coalesce(f1, 0), 6) AS f1", "coalesce(f1, 0) AS f1")}),
q AS (SELECT scheme, avg(f.f1) AS f1, avg(({_HIT})::INT) AS accuracy FROM runs JOIN eval_samples USING (doc_id) JOIN f USING (run_id) WHERE answers IS NOT NULL GROUP BY scheme)
SELECT m.scheme, m.n, round(m.ttft_ms, 6) AS ttft_ms, round(m.kv_mb, 6) AS kv_mb, round(b.ttft_ms / nullif(m.ttft_ms, 0), 6) AS speedup, round(b.kv_mb / nullif(m.kv_mb, 0), 6) AS size_ratio, round(q.f1, 6) AS f1, round(q.accuracy, 6) AS accuracy
FROM m LEFT JOIN (SELECT ttft_ms, kv_mb FROM m WHERE scheme = 'fp16') b ON true LEFT JOIN q ON q.scheme IS NOT DISTINCT FROM m.scheme""",
    "oom_by_scheme": "SELECT scheme, dataset, coalesce(sum(oom), 0)::BIGINT AS oom FROM (SELECT stats_id, any_value(scheme) AS scheme, any_value(dataset) AS dataset, any_value(oom) AS oom FROM lb_scheme_stats GROUP BY stats_id) GROUP BY ALL",
    "slots_default": _with(_KV) + "SELECT doc_id, head, token, slot::INT AS slot, (slot // 16)::INT AS page, (slot % 16)::INT AS \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY token) - 1 AS slot FROM kv)",
    "slots_block_table": _APPENDS + 'SELECT seq_id, "order", n, start, first_block, new_blocks FROM b',
    "slots_physical": _APPENDS + "SELECT seq_id, logical, physical FROM phys",
    "slot_map": _APPENDS + """, m AS (SELECT seq_id, "order", start + k AS token FROM (SELECT *, unnest(range(n)) AS k FROM b)),
      s AS (SELECT m.*, physical * 16 + token % 16 AS slot FROM m JOIN phys ON phys.seq_id = m.seq_id AND phys.logical = m.token // 16)
      SELECT seq_id, "order", arg_min(slot, token) AS first, arg_max(slot, token) AS last, count(*) AS n, sum(slot)::BIGINT AS total FROM s GROUP BY ALL""",
    "manifest_latest": _ROWS + """SELECT store_name, doc_id, layer, scheme, sha256, key, num_tokens, stored_at FROM
      (SELECT *, row_number() OVER (PARTITION BY store_name, doc_id, layer, scheme ORDER BY stored_at DESC NULLS LAST, sha256 DESC NULLS LAST, key DESC NULLS LAST, num_tokens DESC NULLS LAST) AS nth FROM r) WHERE nth = 1""",
    "manifest_verify": _ROWS + f"""SELECT store_name, CASE WHEN sha256 IS DISTINCT FROM sha256(doc_id) THEN 'wrong_hash' WHEN key IS NULL OR key IS DISTINCT FROM {_KEY.format("doc_id", "layer", "scheme")} THEN 'wrong_key' ELSE 'ok' END AS status, count(*) AS n FROM r GROUP BY ALL""",
    "precompute_missing": """
WITH docs AS (SELECT DISTINCT id AS doc_id FROM corpus WHERE removed_at IS NULL AND id IS NOT NULL),
reg AS (SELECT DISTINCT layer_key, layer, scheme FROM layer_registry WHERE retired_at IS NULL),
e AS (SELECT store_name, unnest(map_entries(entries)) AS x FROM manifest),
named AS (SELECT DISTINCT store_name, x.key AS doc_id FROM e),
held AS (SELECT DISTINCT store_name, x.key AS doc_id, unnest(map_keys(x.value.layers)) AS layer_key FROM e),
wanted AS (SELECT store_name, doc_id, layer_key, layer, scheme FROM docs LEFT JOIN named USING (doc_id), reg)
SELECT store_name, doc_id, layer, scheme FROM wanted w WHERE NOT EXISTS
  (SELECT 1 FROM held h WHERE h.doc_id = w.doc_id AND h.layer_key = w.layer_key AND h.store_name IS NOT DISTINCT FROM w.store_name)""",
    "doc_token_count": _ROWS + """, d AS (SELECT DISTINCT id AS doc_id FROM corpus WHERE removed_at IS NULL AND id IS NOT NULL),
      n AS (SELECT doc_id, num_tokens, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(stored_at, '-inf'::DOUBLE) DESC, num_tokens DESC NULLS LAST) AS nth FROM r WHERE layer = 0 AND scheme = 'fp16')
      SELECT doc_id, coalesce(num_tokens, 512) AS num_tokens FROM d LEFT JOIN (SELECT * FROM n WHERE nth = 1) USING (doc_id)""",
    "windowed_latency": "SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 9) AS avg, max(value) AS most FROM events GROUP BY ALL",
    "corpus_files": "SELECT 'r' || seq AS id, md5(text) AS hash FROM corpus WHERE removed_at IS NULL AND text <> ''",
    "eval_loader": f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN context_tokens % 5 <> 0 OR context_tokens IS NULL THEN nullif(context_text, '') END AS c FROM eval_samples),
t AS (SELECT i, coalesce(c, query_prompt, '') AS whole, coalesce(query_prompt, '') AS prompt FROM s WHERE i < 100),
w AS (SELECT *, {_words("whole")} AS w FROM t)
SELECT 'other_' || printf('%04d', i) AS doc_id, CASE WHEN len(w) > 60 THEN array_to_string(list_slice(w, 1, 60), ' ') ELSE whole END AS context_text, {_other()} AS query_prompt, least(len(w), 60)::INT AS context_tokens FROM w""",
    "migrate_plan": f"""
WITH d AS (SELECT DISTINCT id AS doc_id, length(id) AS len FROM corpus WHERE id IS NOT NULL),
two AS (SELECT *, {_KEY.format("doc_id", "3", chr(39) + "two_parts" + chr(39))} || '.bin' AS now FROM d)
SELECT left(md5(doc_id), 12) || '_L03_two_parts.bin' AS name, doc_id, CASE WHEN len % 2 = 0 THEN 'skip' ELSE 'rename' END AS action, now AS new_name FROM two
UNION ALL SELECT k, doc_id, 'adopt', k FROM (SELECT doc_id, {_KEY.format("doc_id", "4", chr(39) + "mse4" + chr(39))} || '.bin' AS k FROM d WHERE len % 3 = 0)""",
    "p2_found": _P2 + "SELECT manifest_id, doc_id, layer_key, ref_table, status FROM found WHERE status IS NOT NULL",
    "p2_report": _P2 + "SELECT ref_table, strftime(make_timestamp((stored_at * 1e6)::BIGINT), '%Y-%m') AS month, status, count(*) AS n_refs, count(DISTINCT doc_id) AS n_docs FROM found WHERE status IS NOT NULL GROUP BY 1, 2, 3",
}
_ALIASES = ", ".join(f"('{a}', '{b}')" for a, b in T.MODEL_ALIASES.items())
SQL["model_alias"] = f"""
WITH known(short, model) AS (VALUES {_ALIASES}), asked(name) AS (SELECT short FROM known UNION ALL SELECT upper(short) FROM known UNION ALL VALUES ('own/Model-1'), (''))
SELECT name, coalesce(model, name) AS model FROM asked LEFT JOIN known ON short = lower(name)"""
SQL["corpus_csv"] = SQL["corpus_files"]
SQL["store_roundtrip"] = SQL["roundtrip_error"]
SQL["migrate_counts"] = f"SELECT action, count(*) AS n FROM ({SQL['migrate_plan']}) GROUP BY action"
SQL["migrate_apply"] = f"""
WITH p AS ({SQL["migrate_plan"]})
SELECT DISTINCT doc_id, sha256(doc_id) AS sha256, CASE WHEN action = 'rename' THEN 3 ELSE 4 END AS layer, CASE WHEN action = 'rename' THEN 'two_parts' ELSE 'mse4' END AS scheme,
  left(new_name, length(new_name) - 4) AS key, CASE WHEN action = 'rename' AND length(doc_id) % 5 = 0 THEN length(doc_id)::INT END AS num_tokens FROM p WHERE action <> 'skip'"""
SQL["dynamic_values"] = _with(_KV) + f"""SELECT doc_id, 0 AS layer, head, count(DISTINCT token)::INT AS tokens,
  sum((token + 1) * (i + 1) * {_FIXED.format('x')}) FILTER (WHERE part = 'k')::BIGINT AS k_total, sum((token + 1) * (i + 1) * {_FIXED.format('x')}) FILTER (WHERE part = 'v')::BIGINT AS v_total FROM el GROUP BY doc_id, head"""
SQL["attn_mse_by_layer"] = " UNION ALL ".join(_attn_mse(n, ", (doc_id::INT % 3)::INT AS layer") for n in layouts.SCHEMES)
SQL["codes_dense16"] = _with(_KV, *(f"{p} AS (SELECT doc_id, head, token, string_agg({_hex16('x')}, '' ORDER BY i) AS {p}_hex FROM el WHERE part = '{p}' GROUP BY ALL)" for p in "kv")) + """
SELECT doc_id, head, token, k_hex, v_hex, -1::BIGINT AS k_scale, -1::BIGINT AS k_residual, -1::BIGINT AS v_scale FROM k JOIN v USING (doc_id, head, token)"""
SQL["page_export"] = f"""
WITH codes AS ({_codes("prod4")}),
slots AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY token) - 1 AS slot FROM codes),
cells AS (SELECT doc_id, slot // 16 AS page, slot % 16 * 2 + head AS cell, k_hex, v_hex, {", ".join(f"{_hex16(f'({c} / 134217728e0)')} AS {c}" for c in ("k_scale", "k_residual", "v_scale"))} FROM slots),
whole AS (SELECT doc_id, page, cell FROM (SELECT DISTINCT doc_id, page FROM cells), range(32) r(cell)),
pages AS (SELECT doc_id, page, {" || ".join(f"string_agg(coalesce({c}, repeat('0', {n})), '' ORDER BY cell)" for c, n in (("k_hex", 64), ("k_residual", 4), ("k_scale", 4), ("v_hex", 64), ("v_scale", 4)))} AS hex FROM whole LEFT JOIN cells USING (doc_id, page, cell) GROUP BY ALL)
SELECT doc_id, 0 AS layer, page::INT AS page, sha256(unhex(hex)) AS sha256, (length(hex) // 2)::INT AS n_bytes FROM pages"""


def _folded(pieces: str, overlap: int, join: str) -> str:
    """Documents' pieces joined up to 96 words, a chunk beginning with the closing pieces of the one before that have at most
    `overlap` words: one step a piece, from chunk to chunk."""
    return f"""
WITH RECURSIVE c AS (SELECT *, list_transform(p, lambda x: len({_words("x")})) AS n FROM
  (SELECT doc_id AS seq, {_stem("source || '/' || doc_id::VARCHAR")} AS stem, list_filter(list_transform({pieces}, lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM documents WHERE {_strip("text")} <> '') WHERE len(p) > 0),
f AS (SELECT seq, 0::BIGINT AS pos, 0::BIGINT AS b, 0::BIGINT AS held, -1::BIGINT AS eb, -1::BIGINT AS ee FROM c
  UNION ALL SELECT seq, pos + 1, CASE WHEN turn THEN pos - k ELSE b END, ((CASE WHEN turn THEN coalesce(list_sum(list_slice(n, pos - k + 1, pos)), 0) ELSE held END) + n[pos + 1])::BIGINT, CASE WHEN turn THEN b ELSE -1 END, CASE WHEN turn THEN pos ELSE -1 END
  FROM (SELECT f.*, n, pos > b AND held + n[pos + 1] > 96 AS turn, CASE WHEN {overlap} = 0 THEN 0 ELSE list_max(list_filter(range(least(pos, {overlap}) + 1), lambda k: coalesce(list_sum(list_slice(n, pos - k + 1, pos)), 0) <= {overlap})) END AS k FROM f JOIN c USING (seq) WHERE pos < len(n))),
cut AS (SELECT seq, eb, ee FROM f WHERE ee >= 0 UNION ALL SELECT f.seq, b, pos FROM f JOIN c USING (seq) WHERE pos = len(n)),
k AS (SELECT cut.*, stem, p, row_number() OVER (PARTITION BY seq ORDER BY ee) - 1 AS chunk, count(*) OVER (PARTITION BY seq) AS total FROM cut JOIN c USING (seq))
SELECT seq, chunk::INT AS chunk, CASE WHEN total = 1 THEN stem ELSE stem || '_c' || printf('%03d', chunk) END AS id, array_to_string(list_slice(p, eb + 1, ee), {join}) AS text FROM k"""


SQL["chunk_sentence"] = _folded(r"string_split(regexp_replace(" + _strip("text") + r", '([.!?])" + _SP + r"+', '\1' || chr(1), 'g'), chr(1))", 16, "' '")
SQL["chunk_paragraph"] = _folded(r"regexp_split_to_array(text, '\n" + _SP + r"*\n')", 0, "chr(10) || chr(10)")
