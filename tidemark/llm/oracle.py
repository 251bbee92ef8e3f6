"""The corpus queries in plain SQL for DuckDB, where SQL can express them."""

OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
  FROM range(2) t(i)
), marked AS (
  SELECT *,
    role IS DISTINCT FROM lag(role) OVER w AS opens,
    role IS DISTINCT FROM lead(role) OVER w AS closes,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) AS role_chars
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens THEN 12 + role_chars + 1 ELSE 11 END
    + CASE WHEN closes THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked
GROUP BY conv_id
"""

OP6_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents
), blocks AS MATERIALIZED (
  SELECT doc, k, list_extract(parts, k) || coalesce(list_extract(parts, k + 1), '') AS two, len(list_extract(parts, k)) // 2 AS own
  FROM (SELECT doc, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc, regexp_extract_all(body, '.{1,800}') AS parts FROM docs))
), starts AS MATERIALIZED (
  SELECT doc, (k - 1) * 400 + o AS start, md5(substr(two, CAST(2 * o + 1 AS BIGINT), 800)) AS name
  FROM (SELECT *, unnest(range(own)) AS o FROM blocks WHERE len(two) >= 800) WHERE len(two) >= 2 * o + 800
), again AS (
  SELECT s.doc, s.start FROM starts s SEMI JOIN (SELECT name FROM starts GROUP BY name HAVING count(*) > 1) r ON s.name = r.name
), runs AS (
  SELECT doc, start, sum(opens) OVER (PARTITION BY doc ORDER BY start) AS run
  FROM (SELECT doc, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc ORDER BY start) <= 400 THEN 0 ELSE 1 END AS opens FROM again)
), spans AS MATERIALIZED (
  SELECT doc, min(start) AS begin, max(start) + 400 AS stop FROM runs GROUP BY doc, run
), kept AS (
  SELECT doc, count(*) AS n_spans, sum(stop - begin) AS n_removed,
    string_agg(substr(body, CAST(2 * former + 1 AS BIGINT), CAST(2 * (begin - former) AS BIGINT)), '' ORDER BY begin)
      || any_value(substr(body, CAST(2 * last_stop + 1 AS BIGINT))) AS rest
  FROM (
    SELECT s.doc, begin, stop, body, coalesce(lag(stop) OVER w, 0) AS former, max(stop) OVER (PARTITION BY s.doc) AS last_stop
    FROM spans s JOIN docs d ON s.doc = d.doc WINDOW w AS (PARTITION BY s.doc ORDER BY begin)
  ) GROUP BY doc
)
SELECT doc_id, CAST(len(body) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, body))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc)
"""

def _spans(kind: str, rank: int, regex: str, group: int, least: int) -> str:
    """Matches of a pattern and what is between them."""
    return f"""SELECT doc, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_split_to_array(text, '{regex}') AS gaps,
    regexp_extract_all(text, '{regex}') AS matches, regexp_extract_all(text, '{regex}', {group}) AS found FROM docs"""


def _either(word: str) -> str:
    """A word of letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP8_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS text FROM documents
), lists AS MATERIALIZED (
  {_spans("assign", 0, _ASSIGN, 2, 12)}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
  UNION ALL {_spans("hex", 2, "[0-9a-f]{16,}", 0, 16)}
  UNION ALL {_spans("owned", 3, "[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20)}
), parts AS (
  SELECT doc, kind, rank, least, len(gaps[i]) AS gap, len(matches[i]) AS size, found[i] AS value, i
  FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM lists)
), placed AS MATERIALIZED (
  SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc, kind ORDER BY i) AS BIGINT) AS stop FROM parts
), owners AS (
  SELECT value, count(DISTINCT coalesce('s' || source, 'null')) AS owners, count(DISTINCT text) AS texts
  FROM placed JOIN docs USING (doc) GROUP BY value
), judged AS MATERIALIZED (
  SELECT doc, kind, rank, stop - size AS start, stop,
    (owners = 1 OR owners <= 2 AND texts <= 10) AND list_aggregate(string_split(value, ''), 'entropy') >= 3
      AND NOT regexp_matches(value, '(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|1234567890|abcdef') AS live,
    kind <> 'owned' AS base, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS mixed
  FROM placed JOIN owners USING (value) WHERE len(value) >= least
), kept AS (
  SELECT * FROM judged WHERE base
  UNION ALL
  SELECT * FROM judged o WHERE NOT base AND live AND mixed
    AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.base AND b.doc = o.doc AND b.start < o.stop AND o.start < b.stop)
), written AS (
  SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (base) AS base_spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN written USING (doc)
"""

_CLASSES = ["' '", r"'[\x09-\x0D]'", r"'\p{Lu}'", r"'\p{Ll}'", "'[0-9]'", "'[.,;:]'", "'[#*$%&|<>]'"]


def _js(a: str, b: str) -> str:
    """Jensen-Shannon distance of two lists."""
    p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"""CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN
      sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: {part(p, q)} + {part(q, p)})) / 2)) END"""


def _sums(c: str, n: int) -> str:
    """A list summed place by place."""
    return "[" + ", ".join(f"CAST(sum({c}[{i}]) AS DOUBLE)" for i in range(1, n + 1)) + "]"
OP7_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT doc, i, md5(array_to_string(words[i:i + 7], ' ')) AS name FROM (SELECT doc, words, unnest(range(1, len(words) - 6)) AS i FROM docs)
), covered AS (
  SELECT doc, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc, unnest(range(i, i + 8)) AS place FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, name) AS n FROM windows) WHERE n > 1
  ) GROUP BY doc
), counted AS MATERIALIZED (
  SELECT d.doc, doc_id, language, words, len(text) AS chars, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT)
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    [{", ".join(f"CAST(len(regexp_extract_all(text, {c})) AS DOUBLE)" for c in _CLASSES)}] AS classes
  FROM docs d LEFT JOIN covered c ON d.doc = c.doc
), based AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_append(classes, chars - list_sum(classes)) AS char_counts FROM counted
), spread AS MATERIALIZED (
  SELECT doc, language, base_failed, lower(word) AS word, count(*) AS n, regexp_matches(word, '^\p{{L}}+$') AS letters
  FROM (SELECT doc, language, base_failed, unnest(words) AS word FROM based) GROUP BY ALL
), totals AS (
  SELECT language, word, sum(n) AS n FROM (
    SELECT language, word, n FROM spread WHERE letters AND NOT base_failed AND language <> ''
    UNION ALL SELECT '', word, n FROM spread WHERE letters AND NOT base_failed
  ) GROUP BY language, word
), common AS MATERIALIZED (
  SELECT * FROM (SELECT language, word, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS place FROM totals) WHERE place <= 16
), met AS (
  SELECT s.doc, c.place, sum(s.n) AS n FROM spread s JOIN common c USING (language, word) WHERE letters GROUP BY s.doc, c.place
), histograms AS (
  SELECT doc, [{", ".join(f"CAST(coalesce(sum(n) FILTER (place = {k}), 0) AS DOUBLE)" for k in range(1, 17))}] AS known FROM met GROUP BY doc
), measured AS MATERIALIZED (
  SELECT b.*, list_append(coalesce(known, list_resize([0::DOUBLE], 16, 0)), n_words - coalesce(list_sum(known), 0)) AS word_counts
  FROM based b LEFT JOIN histograms h ON b.doc = h.doc
), refs AS (
  SELECT language, {_sums("char_counts", 8)} AS ref_chars, {_sums("word_counts", 17)} AS ref_words FROM measured WHERE NOT base_failed GROUP BY language
), compared AS (
  SELECT m.*, {_js("char_counts", "ref_chars")} AS char_distance, {_js("word_counts", "ref_words")} AS word_distance
  FROM measured m LEFT JOIN refs r ON m.language = r.language
)
SELECT doc_id, n_words, word_chars, CAST(classes[7] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(chars >= 150 AND char_distance > 0.22 + 1.7 / sqrt(chars), false)
    AND NOT coalesce(n_words >= 30 AND word_distance > 0.20 + 1.2 / sqrt(n_words), false) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM compared
"""

OP9_SQL = r"""
WITH items AS MATERIALIZED (
  SELECT row_number() OVER () AS item, CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), sized AS MATERIALIZED (
  SELECT item_id, words, least(13, len(words)) AS size FROM items WHERE len(words) > 0
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS window_words
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), places AS MATERIALIZED (
  SELECT d.doc, s.size, unnest(range(1, len(d.words) - s.size + 2)) AS i, d.words
  FROM docs d, (SELECT DISTINCT size FROM sized) s WHERE len(d.words) >= s.size
), met AS MATERIALIZED (
  SELECT p.doc, p.i, p.size, p.window_words
  FROM (SELECT doc, i, size, array_to_string(words[i:i + size - 1], ' ') AS window_words FROM places) p
  SEMI JOIN windows w ON p.size = w.size AND p.window_words = w.window_words
), hit AS (
  SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + size)) AS place FROM met) GROUP BY doc
), named AS (
  SELECT doc, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids
  FROM (SELECT DISTINCT m.doc, w.item_id FROM met m JOIN windows w USING (size, window_words) WHERE w.item_id IS NOT NULL)
  GROUP BY doc
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM docs LEFT JOIN hit USING (doc) LEFT JOIN named USING (doc)
"""

OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(text))) AS shuffle_key
  FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT CAST(0 AS DOUBLE) AS level, 0 AS step
  UNION ALL
  SELECT (SELECT
      CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= f.level * weight), 0) AS DOUBLE)
      / nullif(sum(weight) FILTER (3 * source_size > f.level * weight), 0)
    FROM weighed), step + 1
  FROM filled f WHERE step < 40 AND level IS NOT NULL
), targets AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM filled) * weight) AS target FROM weighed
), queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.weight,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY shuffle_key, s.size, s.doc_id
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT size, CAST(upto + epoch * source_size AS DOUBLE) / weight AS finish
  FROM queued, range(3) e(epoch) WHERE size > 0
), ordered AS (
  SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS words FROM entries GROUP BY finish
), cut AS (
  SELECT coalesce(min(finish), 'inf'::DOUBLE) AS finish FROM ordered
  WHERE words > (SELECT sum(size) FROM sized)
)
SELECT doc_id, size, source_size, target, CAST(size * (
  CAST(CAST(upto AS DOUBLE) / weight < cut.finish AS INT)
  + CAST(CAST(upto + source_size AS DOUBLE) / weight < cut.finish AS INT)
  + CAST(CAST(upto + 2 * source_size AS DOUBLE) / weight < cut.finish AS INT)) AS BIGINT) AS taken
FROM queued, cut
"""


def _assigned(round_: int) -> str:
    """Nearest entry of each part in the codebooks of a round, the first of equally near ones."""
    return f"""a{round_} AS MATERIALIZED (
  SELECT vec, part, min(distance) AS distance, arg_min(entry, distance * 256 + entry) AS entry
  FROM (
    SELECT v.vec, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS distance
    FROM components v JOIN b{round_} b USING (part, place) GROUP BY v.vec, v.part, b.entry
  ) GROUP BY vec, part
)"""


def _moved(round_: int) -> str:
    """Codebooks with each entry at the mean of the parts assigned to it in the round before."""
    return f"""b{round_} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x
  FROM b{round_ - 1} b LEFT JOIN (
    SELECT v.part, a.entry, v.place, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM components v JOIN a{round_ - 1} a USING (vec, part) GROUP BY v.part, a.entry, v.place
  ) m USING (part, entry, place)
)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS vec, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS whole
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS MATERIALIZED (
  SELECT vec, (i - 1) * 4 // len(whole) AS part, (i - 1) % (len(whole) // 4) AS place, whole[i] AS x
  FROM (SELECT vec, whole, unnest(range(1, len(whole) + 1)) AS i FROM kept)
), b0 AS MATERIALIZED (
  SELECT part, vec AS entry, place, x FROM components WHERE vec < 256
), {", ".join(f"{_assigned(r)}, {_moved(r + 1)}" for r in range(4))}, {_assigned(4)}, digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b4
), codes AS (
  SELECT vec, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM a4 GROUP BY vec
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN codes c USING (vec), digest d
"""

OP13_SQL = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS nth,
    first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to
FROM payloads
"""
