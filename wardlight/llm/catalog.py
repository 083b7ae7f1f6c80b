"""The dealt operators as registered queries, with the SQL each is checked against where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.llm.blocks import documents
from wardlight.llm.conversation_repair import damage, repair_chunks, report
from wardlight.llm.decontaminate import contamination
from wardlight.llm.fingerprints import fingerprint_documents
from wardlight.llm.html_extract import extract_text
from wardlight.llm.importance import resample
from wardlight.llm.ngram_join import similar_documents
from wardlight.llm.packing import pack_documents
from wardlight.llm.private_data import KINDS, find_private
from wardlight.llm.private_data import listed as private_listed
from wardlight.llm.quality import score_quality
from wardlight.llm.secret_scan import RULES, listed, record, scan
from wardlight.llm.suffix_dedup import remove_repeated_bytes
from wardlight.llm.token_file import read_token_file, write_token_file
from wardlight.llm.tokens import byte_vocabulary
from wardlight.llm.window_dedup import remove_repeated_windows
from wardlight.session import scratch_path

QUERIES, SQL = {}, {}


def op10_substring_dedup(spark, sf_dir):
    return remove_repeated_windows(documents(spark, sf_dir)).drop("kept")


QUERIES["op10_substring_dedup"] = op10_substring_dedup
SQL["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13),
h AS (SELECT doc_id, p, list_aggregate(words[p:p + 12], 'string_agg', ' ') AS win FROM g),
first AS (SELECT win, min(doc_id) AS first_doc FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM h JOIN first USING (win) WHERE first_doc < doc_id),
gone AS (SELECT doc_id, list(pos) AS gone FROM hit GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def op2_suffix_array_dedup(spark, sf_dir):
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("kept")


QUERIES["op2_suffix_array_dedup"] = op2_suffix_array_dedup


def op4_decontamination(spark, sf_dir):
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


QUERIES["op4_decontamination"] = op4_decontamination
SQL["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0),
q0 AS (SELECT item_id, w, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS win, len(w[p:p + 12]) AS n FROM p),
q AS (SELECT item_id, win, n FROM q0),
lens AS (SELECT DISTINCT n FROM q),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, p, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS win FROM dp),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN q ON dw.win = q.win),
pos AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id),
dt AS (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS term, unnest(range(len(w))) AS pos FROM d),
cnt AS (SELECT term, count(*) AS n FROM dt GROUP BY term),
wt AS (SELECT win, unnest(list_transform(w, lambda x: lower(x))) AS term, unnest(range(len(w))) AS off FROM (SELECT win, any_value(w[p:p + 12]) AS w FROM q0 GROUP BY win)),
rk AS (SELECT win, term, off, row_number() OVER (PARTITION BY win ORDER BY n, term, off) AS r, min(coalesce(n, 0)) OVER (PARTITION BY win) AS least FROM wt LEFT JOIN cnt USING (term)),
pr AS (SELECT win, max(term) FILTER (r = 1) AS t1, max(off) FILTER (r = 1) AS o1, max(term) FILTER (r = 2) AS t2, max(off) FILTER (r = 2) AS o2, max(term) FILTER (r = 3) AS t3, max(off) FILTER (r = 3) AS o3 FROM rk WHERE least > 0 GROUP BY win),
c1 AS (SELECT doc_id, win, pos - o1 AS s, t2, o2, t3, o3 FROM pr JOIN dt ON dt.term = t1 WHERE pos >= o1),
c2 AS (SELECT * FROM c1 WHERE t2 IS NULL OR EXISTS (SELECT 1 FROM dt WHERE dt.doc_id = c1.doc_id AND dt.term = c1.t2 AND abs(dt.pos - c1.s - c1.o2) <= 2)),
c3 AS (SELECT * FROM c2 WHERE t3 IS NULL OR EXISTS (SELECT 1 FROM dt WHERE dt.doc_id = c2.doc_id AND dt.term = c2.t3 AND abs(dt.pos - c2.s - c2.o3) <= 2)),
nr AS (SELECT doc_id, count(DISTINCT win) AS n_near FROM c3 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
"""


def op9_secret_scan(spark, sf_dir):
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), scratch_path(spark, "ledger")
    record(docs.where(F.xxhash64("text") < 0), ledger)  # an earlier run that saw about half of the contents; the next one scans the others
    found = scan(docs, ledger)
    spans = listed(F.col("findings"))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i, {least} AS least FROM (
  SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS parts, string_split_regex(t, '{quoted}') AS gaps FROM t)"""


QUERIES["op9_secret_scan"] = op9_secret_scan
SQL["op9_secret_scan"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(RULES, 1))}),
s AS (SELECT doc_id, rank, kind, parts[i] AS part, least, hits[i] AS hit, len(list_aggregate(gaps[1:i], 'string_agg', '')) + coalesce(len(list_aggregate(hits[1:i - 1], 'string_agg', '')), 0) AS a FROM m),
k AS (SELECT doc_id, rank, kind, a, kind || ':' || a || ':' || (a + len(hit)) AS span FROM s WHERE len(part) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


def op1_quality_classifier(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES["op1_quality_classifier"] = op1_quality_classifier


def op8_fingerprints(spark, sf_dir):
    return fingerprint_documents(documents(spark, sf_dir))


QUERIES["op8_fingerprints"] = op8_fingerprints


def op5_token_file(spark, sf_dir):
    folder = scratch_path(spark, "token-file")
    write_token_file(documents(spark, sf_dir), folder, byte_vocabulary(), end=0)
    return read_token_file(spark, folder)


QUERIES["op5_token_file"] = op5_token_file


def op7_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), byte_vocabulary(), window=2048, end=1)


QUERIES["op7_packing"] = op7_packing


def op6_ngram_join(spark, sf_dir):
    return similar_documents(documents(spark, sf_dir))


QUERIES["op6_ngram_join"] = op6_ngram_join
SQL["op6_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(words[p:p + 2], 'string_agg', ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(v, l) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, l FROM r JOIN e ON a = v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.l) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.v = w.doc_id GROUP BY w.doc_id, n.n
"""


def op3_html_extraction(spark, sf_dir):
    return extract_text(documents(spark, sf_dir, "pages"))


QUERIES["op3_html_extraction"] = op3_html_extraction


def _crc32_sql(text: str) -> str:
    """DuckDB has no CRC-32: eight steps of a shift register for each byte."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    steps = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: {bit.format('s')})"
    codes = f"list_transform(range(1, strlen({text}) * 2, 2), lambda p: ('0x' || hex(encode({text}))[p:p + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {steps}), 4294967295)"


def op12_importance_resampling(spark, sf_dir):
    return resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES["op12_importance_resampling"] = op12_importance_resampling
SQL["op12_importance_resampling"] = rf"""
WITH both_ AS (SELECT 'd' AS kind, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_),
p AS (SELECT kind, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
f AS (SELECT kind, doc_id, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS g, count(*) AS c FROM p GROUP BY ALL),
crc AS MATERIALIZED (SELECT g, {_crc32_sql("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)),
b AS (SELECT kind, doc_id, bucket, sum(c) AS c FROM f JOIN crc USING (g) GROUP BY ALL),
n AS (SELECT bucket, coalesce(sum(c) FILTER (kind = 'd'), 0) AS s, coalesce(sum(c) FILTER (kind = 'b'), 0) AS t FROM b GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
wt AS (SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM b JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
sc AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
       FROM w LEFT JOIN wt USING (doc_id) WHERE kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 5 * able // 100 THEN rank END::BIGINT AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""


def op11_conversation_repair(spark, sf_dir):
    conversations = documents(spark, sf_dir, "conversations")
    return report(repair_chunks(damage(conversations)), conversations)


def _least_repair_sql() -> str:
    """Forward search over turns; a state is one string of cost (10 digits), audit, chr(1), repaired turns, of which the least wins."""
    def more(state: str, cost: str, letter: str, turn: str | None) -> str:
        said = f"chr(10) || {turn}" if turn else "''"
        return f"lpad(({state}[1:10]::BIGINT + {cost})::VARCHAR, 10, '0') || split_part({state}[11:], chr(1), 1) || '{letter}' || chr(1) || split_part({state}, chr(1), 2) || {said}"

    own, ok = "role || ':' || text", "NOT gone"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN {ok} AND role[1:1] = '{initial}' THEN {more(state, 'extra', 'K', own)} END"

    def turned(state: str, role: str) -> str:
        said = f"'{role}:' || text"
        return f"CASE WHEN {ok} THEN {more(state, '3 + extra', 'R', said)} END"

    acted = [
        more("s0", "4", "D", None),
        f"least({more('s1', '4', 'D', None)}, {kept('s0', 's')})",
        f"least({more('s2', '4', 'D', None)}, {', '.join(x for s in ('s0', 's1', 's3') for x in (kept(s, 'u'), turned(s, 'user')))})",
        f"least({more('s3', '4', 'D', None)}, {kept('s2', 'a')}, {turned('s2', 'assistant')})",
    ]
    user = ", ".join(more(f"n{k}", "3", "I", "'user:'") for k in (0, 1, 3))
    return f"""
r(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, '0000000000' || chr(1), NULL::VARCHAR, '0000000003I' || chr(1) || chr(10) || 'user:', '0000000006II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' FROM ids
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, least(n3, {more('m2', '3', 'I', "'assistant:'")}) FROM (SELECT *, least(n2, {user}) AS m2 FROM (
    SELECT r.conv_id, f.i, {', '.join(f'{x} AS n{k}' for k, x in enumerate(acted))} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)))"""


QUERIES["op11_conversation_repair"] = op11_conversation_repair
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
g AS (SELECT *, {_crc32_sql("name")} % 20 AS d FROM k),
x AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM x),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra,
        lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before FROM o),
a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (i > 1 AND role_before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
{_least_repair_sql()},
z AS (SELECT conv_id, i, least(s0, s3) AS best FROM r)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best[1:10]::BIGINT AS cost, split_part(best[11:], chr(1), 1) AS audit, sha256(split_part(best, chr(1), 2)[2:]) AS repaired_sha256
FROM ids LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN z ON z.conv_id IS NOT DISTINCT FROM ids.conv_id AND z.i = coalesce(a.n, 0)
"""


def op13_private_data(spark, sf_dir):
    found = find_private(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["exact"])

    def count(k, name):
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[count(k, name) for k, name in enumerate(KINDS)], F.sha2(private_listed(base), 256).alias("base_sha256"), private_listed(F.col("spans")).alias("spans"))


QUERIES["op13_private_data"] = op13_private_data
