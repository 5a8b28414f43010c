"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import quality as Q

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def decontamination(width: int = 10) -> str:
    """Every window of the items against every window of the documents, by equality."""
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {width}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, i, k, item FROM dw JOIN win USING (k, g)),
pos AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""


def _estimate(near: str, name: str, p: Q.Params) -> str:
    """Means ``m_k`` and Cholesky factor ``l_ij`` of each group from the rows of ``near``."""
    x, n = Q.X, len(Q.X)
    sums = {f"s_{k}": f"sum({k})" for k in x} | {f"p_{a}{b}": f"sum({a} * {b})" for i, a in enumerate(x) for b in x[:i + 1]}
    lean = {c: f"(t.{c} + ({float(p.lean)} / l.m) * l.{c}) / (t.m + {p.lean})" for c in sums}
    cov = [f"p_{a}{b} - s_{a} * s_{b} + {float(p.floors[i]) ** 2 if a == b else 0.0} AS c{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x[:i + 1])]
    out = [f"{name}_t AS (SELECT g1, g2, count(*) AS m, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in sums.items())} FROM {near} GROUP BY g1, g2)",
           f"{name}_l AS (SELECT g1, sum(m) AS m, {', '.join(f'sum({k}) AS {k}' for k in sums)} FROM {name}_t GROUP BY g1)",
           f"{name}_w AS (SELECT t.g1, t.g2, {', '.join(f'{v} AS {k}' for k, v in lean.items())} FROM {name}_t t JOIN {name}_l l ON l.g1 = t.g1)",
           f"{name}_c AS (SELECT g1, g2, {', '.join(f's_{k} AS m_{k}' for k in x)}, {', '.join(cov)} FROM {name}_w)"]
    last = f"{name}_c"
    for i in range(n):
        for j in range(i + 1):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(greatest({rest}, 1.0))" if i == j else f"({rest}) / l{j}{j}"
            out.append(f"{name}_{i}{j} AS (SELECT *, {value} AS l{i}{j} FROM {last})")
            last = f"{name}_{i}{j}"
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {last})"])


def _distance(estimate: str, name: str) -> str:
    x, out, last = Q.X, [], f"(SELECT good.*, {estimate}.* EXCLUDE (g1, g2) FROM good JOIN {estimate} USING (g1, g2))"
    for i, k in enumerate(x):
        y = f"({k} - m_{k})" + "".join(f" - l{i}{j} * y{j}" for j in range(i))
        out.append(f"{name}_{i} AS (SELECT *, ({y}) / l{i}{i} AS y{i} FROM {last})")
        last = f"{name}_{i}"
    total = " + ".join(f"y{i} * y{i}" for i in range(len(x)))
    return ",\n".join([*out, f"{name} AS (SELECT * EXCLUDE ({', '.join(f'y{i}' for i in range(len(x)))}), {total} AS d2 FROM {last})"])


def _nearest(rows: str, name: str, p: Q.Params) -> str:
    return f"""{name}_q AS (SELECT *, CAST(round(100 * sqrt(d2)) AS BIGINT) AS q FROM {rows}),
{name}_b AS (SELECT g1, g2, quantile_cont(q, {p.keep}) AS bound FROM {name}_q GROUP BY g1, g2),
{name} AS (SELECT r.* FROM {name}_q r JOIN {name}_b b ON b.g1 = r.g1 AND b.g2 = r.g2 WHERE q <= bound)"""


def quality(p: Q.Params = Q.Params()) -> str:
    """Base statistics by windows over exploded words; the same concentration
    steps as set operations."""
    x, k = Q.X, len(Q.X)
    space = r"[\x20\x09-\x0D]"
    share = lambda c: f"ln(1 + 100 * {c} / greatest(n_words, 1))"
    vector = ("ln(greatest(n_words, 1))", "word_chars / greatest(n_words, 1)", share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    start = " + ".join(f"pow(o_{c} / greatest(1.4826 * v_{c}, {float(f)}), 2)" for c, f in zip(x, p.floors))
    steps = []
    rows = "far0"
    for s in range(p.steps):
        steps += [_nearest(rows, f"near{s}", p), _estimate(f"near{s}", f"est{s}", p), _distance(f"est{s}", f"dist{s}")]
        rows = f"dist{s}"
    inside = Q.chi2_quantile(p.keep, k)
    widen = p.keep / Q.chi2_cdf(inside, k + 2)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{space}+'), lambda v: v <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS full_lines FROM t),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
      SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
s AS (SELECT w.r, doc_id, coalesce('=' || lang, '-') AS g1, coalesce('=' || source, '-') AS g2, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      {', '.join(f'CAST(round(100 * ({e})) AS BIGINT) AS {c}' for c, e in zip(x, vector))} FROM s),
good AS (SELECT * FROM v WHERE NOT base_failed),
mid AS (SELECT g1, g2, {', '.join(f'quantile_cont({c}, 0.5) AS c_{c}' for c in x)} FROM good GROUP BY g1, g2),
off AS (SELECT good.*, {', '.join(f'abs({c} - c_{c}) AS o_{c}' for c in x)} FROM good JOIN mid USING (g1, g2)),
spr AS (SELECT g1, g2, {', '.join(f'quantile_cont(CAST(round(o_{c}) AS BIGINT), 0.5) AS v_{c}' for c in x)} FROM off GROUP BY g1, g2),
far0 AS (SELECT off.*, {start} AS d2 FROM off JOIN spr USING (g1, g2)),
{(',' + chr(10)).join(steps)},
fin AS (SELECT r, d2 / {widen!r} AS d2 FROM {rows})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(d2 <= {Q.chi2_quantile(p.cutoff, k)!r}, false) AS kept, round(d2, 6) AS d2
FROM v LEFT JOIN fin USING (r)
"""


def warc() -> str:
    """Base32 by groups of 20 bits: five hexadecimal digits, four letters."""
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31), 1)"
                          for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH x AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
y AS (SELECT *, count(*) OVER (PARTITION BY html) AS n, max(page_id) OVER (PARTITION BY html) AS first FROM x)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM y
"""


def runs() -> str:
    """Runs as islands of equal words at each distance."""
    crc = ("4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
           "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc} AS h FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
f AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM e),
t AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM f),
eq AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g, i FROM eq),
run AS (SELECT r, s, e, min(q) AS q FROM (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM isle GROUP BY r, q, g)
        WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM run),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON gone.r = t.r AND gone.i = t.i GROUP BY t.r),
sums AS (SELECT r, count(*) AS n, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                first({{'s': s, 'l': e - s, 'q': q}} ORDER BY CAST(e - s AS DOUBLE) / q DESC, s, q) AS b FROM run GROUP BY r)
SELECT doc_id, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM f LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


def search(k: int = 10) -> str:
    """Every posting of every item's terms."""
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT row_number() OVER () AS i, item_id, {words} AS w FROM benchmark),
qt AS (SELECT i, term, count(*) AS qtf FROM (SELECT i, unnest(w) AS term FROM q) GROUP BY i, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2.0::DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
sc AS (SELECT qt.i, d.r, CAST(sum(qtf * df.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN d ON d.r = tf.r, s GROUP BY qt.i, d.r),
o AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM sc JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN q USING (i) JOIN d USING (r) WHERE rank <= {k}
"""
