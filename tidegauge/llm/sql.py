"""DuckDB SQL for the corpus queries that SQL can express."""

OP1 = r"""
WITH v AS (
  SELECT page_id * 4 + k AS id, page_id + k * 45000 AS ts, k, html, url AS page_url,
         CASE WHEN k % 2 = 1 THEN url || '#v' ELSE url END AS url,
         ('0x' || substr(md5(page_id || ':' || k), 1, 6))::BIGINT AS draw, substr(md5(coalesce(url, '')), 1, 8) AS version
  FROM pages, unnest(range(0, 4)) AS t(k)),
r AS (
  SELECT *, CASE WHEN k = 0 THEN draw % 10 > 0 ELSE draw % 3 = 0 END AS is_full, CASE WHEN draw % 11 = 5 THEN 'other' ELSE version END AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM v),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS address,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS params
  FROM r),
c AS (SELECT *, address || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM q),
j AS (
  SELECT c.*, f.id AS old_id, f.ts AS old_ts, f.version AS old_version, md5(f.html) AS old_digest, length(f.html) AS old_length,
         row_number() OVER (PARTITION BY c.id ORDER BY f.ts DESC NULLS LAST, f.id DESC NULLS LAST) AS n
  FROM c LEFT JOIN (SELECT * FROM c WHERE is_full) f
    ON f.canonical = c.canonical AND (f.ts < c.ts OR f.ts = c.ts AND f.id < c.id)
  WHERE NOT c.is_full)
SELECT id AS record_id, canonical, ts,
       CASE WHEN old_id IS NULL THEN 'no_response' WHEN tag = old_version THEN 'resolved' ELSE 'validator_mismatch' END AS verdict,
       coalesce(old_id, -1) AS refers_to, coalesce(old_ts, -1) AS refers_ts,
       CASE WHEN tag = old_version THEN old_digest END AS digest,
       CASE WHEN tag = old_version THEN 'cache-control=max-age=60;content-length=' || old_length || ';content-type=text/html;date=' || ts
            || ';etag=W/"' || tag || '"' END AS headers
FROM j WHERE n = 1
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM m, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
h AS (
  SELECT *, role = 'user' AND turn % 3 = 0 AS asked, length(text) AS size, length(text) // 2 AS half,
         CASE length(text) % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'document' END AS kind
  FROM t),
p AS (
  SELECT *, CASE WHEN asked THEN [substr(text, 1, half), substr(text, half + 1)] ELSE [text] END AS texts,
         CASE kind WHEN 'image' THEN ceil((size + 1) / 28) * 2 WHEN 'audio' THEN greatest(ceil(size / 4 * 25), 1) ELSE (size % 4 + 1) * 512 END AS tokens
  FROM h),
e AS (
  SELECT *, replace(texts[1], chr(1), chr(1) || 't')
           || CASE WHEN asked THEN chr(1) || 'p' || kind || ';' || replace(texts[2], chr(1), chr(1) || 't') ELSE '' END AS marked,
         list_sum(list_transform(texts, lambda x: length(replace(replace(replace(replace(x, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<|', '\p'))))
         + CASE WHEN asked THEN length(kind) + 4 ELSE 0 END AS n
  FROM p),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, marked) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, marked) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(n + length(role) + 14) AS chars, count(*) FILTER (WHERE asked) AS n_attachments,
         coalesce(sum(tokens) FILTER (WHERE asked), 0) AS attachment_tokens,
         coalesce(string_agg(kind || ':' || conv_id || '/' || turn || ':' || CAST(tokens AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, marked)
                  FILTER (WHERE asked), '') AS attached
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, n_attachments,
       CAST(attachment_tokens AS BIGINT) AS attachment_tokens, sha256(attached) AS attachments_sha256
FROM g
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
r AS (
  SELECT doc_id, text, lines, CAST(len(lines) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
c AS (
  SELECT *, array_to_string(list_slice(lines, 1, a), '') AS p, array_to_string(list_slice(lines, a + 1, b), '') AS m,
         array_to_string(list_slice(lines, b + 1, n), '') AS s
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, array_to_string(list_slice(words, i, i + 1), ' ') AS phrase, max(a) AS most
  FROM c, unnest([1, 2]) AS t(i) WHERE k = 3 GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, cut, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM c, unnest(range(1, c.k)) AS t(cut)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(words, 1, cut), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(words, cut + 1, c.k), ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE place = 1 AND coalesce(100 * most < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_warc_revisits": OP1,
    "op6_benchmark_decontamination": OP6,
    "op7_chat_format": OP7,
    "op11_fill_in_middle": OP11,
    "op12_collocations": OP12,
}
