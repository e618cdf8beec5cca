"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netscale.llm import host_reputation, language_id, license_scan, syncmers, warc
from netscale.llm.chat_format import chat_examples, digests
from netscale.llm.common import shared_dir, table, written
from netscale.llm.decontamination import contaminated
from netscale.llm.divergence import divergence
from netscale.llm.fill_in_middle import fill_in_middle, restore
from netscale.llm.jaccard_join import jaccard_components
from netscale.llm.packing import harmonic_pack
from netscale.llm.substring_dedup import substring_dedup
from netscale.llm.token_counts import token_counts


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Allowed and blocked hosts and paths.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url: by the rules, else by its host's reputation among pages that `labels` covers by id."""
    bad = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), bad, RULES).drop("bad_rate")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier document has."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(kept, F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and sentences of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from the examples of all conversations, and of one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(chat_examples(turns.unionByName(more)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of them is never learnt from. The fold of a null doc_id is that of an empty one."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.fit(docs, path, fold != 2)
    plain = docs.select("doc_id", (fold == 2).alias("held_out"), "text")
    return language_id.identify(plain, path, model).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other numbers, names and units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that is empty at first."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache).drop("text")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the vocabularies of the sources of each language diverge."""
    return divergence(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each, read back and assembled into captures."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = written(warc.read_archives(spark, path, without=("response", "request")), "records")
    return warc.pages_of(written(warc.captures(records), "captures"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and its text rebuilt from that."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filter, op3_substring_dedup, op4_syncmer_fingerprints, op5_license_scan, op6_chat_format, op7_jaccard_join, op8_language_id, op9_decontamination, op10_token_counts, op11_divergence, op12_warc, op13_fill_in_middle)}


def _rule_sql(part: str) -> str:
    """CASE over the rules, longest first: the rule or its verdict."""
    whens = []
    for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = f"(host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')"
        whens.append(f"WHEN {fits} THEN '{text if part == 'rule' else said}'")
    return "CASE " + " ".join(whens) + " END"


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SHRINK = "(m * strength + k) / (n + strength) AS mean, n + strength AS weight"
_STRENGTH = """(SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, coalesce(sum(n * pow(k / n - m, 2) - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001::DOUBLE))) - 1 AS strength FROM {0})"""

OP2_SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.?$|\\.(:[0-9]*)?$', '') AS own FROM u), parts AS (SELECT host, own, string_split(own, '.') AS p FROM bare),
lv AS (SELECT host, CASE WHEN plain THEN own WHEN long THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain, CASE WHEN plain THEN own WHEN long THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM (SELECT *, regexp_matches(own, '^[0-9.]*$') OR len(p) < 2 AS plain, array_to_string(p[-2:], '.') IN ({", ".join(f"'{t}'" for t in host_reputation.SHARED)}) OR regexp_matches(p[-1], '^[a-z][a-z]$') AND p[-2] IN ({", ".join(f"'{t}'" for t in host_reputation.SECOND)}) AS long FROM parts)),
o AS (SELECT host, greatest(1 - quality, toxic) AS bad FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT host, sum(bad)::DOUBLE AS k, count(*) AS n FROM o GROUP BY host),
hl AS (SELECT h.*, domain, suffix FROM h JOIN lv USING (host)),
dl AS (SELECT domain, suffix, sum(k) AS k, sum(n)::BIGINT AS n FROM hl GROUP BY 1, 2),
sl AS (SELECT suffix, sum(k) AS k, sum(n)::BIGINT AS n FROM dl GROUP BY 1),
t AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m, (coalesce(sum(n), 0) + 1)::DOUBLE AS weight FROM sl),
s0 AS (SELECT sl.*, m FROM sl, t), s1 AS (SELECT suffix, {_SHRINK} FROM s0, {_STRENGTH.format("s0")}),
d0 AS (SELECT dl.*, mean AS m FROM dl JOIN s1 USING (suffix)), d1 AS (SELECT domain, {_SHRINK} FROM d0, {_STRENGTH.format("d0")}),
h0 AS (SELECT hl.*, mean AS m FROM hl JOIN d1 USING (domain)), h1 AS (SELECT host, {_SHRINK} FROM h0, {_STRENGTH.format("h0")}),
j AS (SELECT lv.host, coalesce(h1.mean, d1.mean, s1.mean, t.m) AS mean, coalesce(h1.weight, d1.weight, s1.weight, t.weight) AS weight FROM lv LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), t)
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, CASE WHEN mean - 1.2816::DOUBLE * sqrt(mean * (1 - mean) / (weight + 1)) > 0.3::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN j USING (host)"""

_GRAMS = ", ".join(
    f"({i}, '{label}', {str(i < len(license_scan.PHRASES)).lower()}, {p}, '{w[p]} {w[p + 1]}')"
    for i, (text, label) in enumerate(license_scan.PHRASES + license_scan.TEMPLATES)
    for w in [text.split()]
    for p in range(len(w) - 1)
    if i < len(license_scan.PHRASES) or not license_scan.COMMON.issuperset(w[p : p + 2])
)

OP5_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
grams(template, label, base, place, gram) AS (VALUES {_GRAMS}),
full_of AS (SELECT template, count(*) AS n FROM grams GROUP BY 1),
g AS (SELECT doc_id, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS gram FROM w, unnest(range(1, len(words))) AS r(i)),
hit AS (SELECT DISTINCT doc_id, template, label, base, pos - place AS diagonal, place FROM g JOIN grams USING (gram)),
line AS (SELECT doc_id, template, label, diagonal FROM hit JOIN full_of f USING (template) WHERE base GROUP BY 1, 2, 3, 4, f.n HAVING count(*) = f.n),
middle AS (SELECT DISTINCT doc_id, template, diagonal AS middle FROM hit WHERE NOT base),
placed AS (SELECT h.doc_id, h.template, h.label, m.middle, h.place, arg_min(h.diagonal, (abs(h.diagonal - m.middle), h.diagonal)) AS diagonal
  FROM middle m JOIN hit h ON h.doc_id = m.doc_id AND h.template = m.template AND NOT h.base AND h.diagonal BETWEEN m.middle - {license_scan.WIDE} AND m.middle + {license_scan.WIDE} GROUP BY 1, 2, 3, 4, 5),
agree AS (SELECT doc_id, template, middle, count(DISTINCT diagonal + place + k) AS here, count(DISTINCT place + k) AS there, max(diagonal + place + k) - min(diagonal + place + k) + 1 AS len_here, max(place + k) - min(place + k) + 1 AS len_there
  FROM placed, unnest(range(0, {license_scan.K})) AS r(k) GROUP BY 1, 2, 3),
share AS (SELECT p.doc_id, p.template, p.label, p.middle, count(DISTINCT place) / max(f.n)::DOUBLE AS share, least(max(here), max(there)) / greatest(max(len_here), max(len_there))::DOUBLE AS alike
  FROM placed p JOIN full_of f ON f.template = p.template JOIN agree a ON a.doc_id = p.doc_id AND a.template = p.template AND a.middle = p.middle GROUP BY 1, 2, 3, 4),
found AS (SELECT doc_id, diagonal AS start, label AS base_label, label, 1.0::DOUBLE AS share FROM line UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN share >= {license_scan.SHARE}::DOUBLE AND alike >= {license_scan.ALIKE}::DOUBLE THEN label END, share FROM share),
f AS (SELECT doc_id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT base_label, ',' ORDER BY base_label) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM w LEFT JOIN f USING (doc_id)"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id"""

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, {_UPPER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS nl FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, k.term, nl, coalesce(n, 0)::HUGEINT AS n, count(*) OVER s AS v, sum(coalesce(n, 0)) OVER s AS total, sum(nl) OVER s AS total_lang
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term WINDOW s AS (PARTITION BY g.lang, g.source)),
p AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS p, (1 + (1000000000 * (nl::HUGEINT + 5)) // (total_lang + 5 * v))::BIGINT AS q FROM x),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(y.p - z.p)) FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term WHERE y.lang = a.lang AND y.source = a.source AND z.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM s),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN holder END AS refers_to FROM r"""

_H = [f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4)]

OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {", ".join(_H)} FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM t),
p AS (SELECT doc_id, text, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

SQL = {
    "op11_divergence": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
    "op2_url_filter": OP2_SQL,
    "op5_license_scan": OP5_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)([^\\<>\[\] \t\n\r][^<>\[\]\n]{0,59}[>\]])', '\1\2\\\3', 'g') AS body FROM c),
s AS (SELECT *, sum(12 + length(role) + 1 + length(body) + 11) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(upto) FILTER (role = 'assistant' OR last) AS formatted FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM g""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(words) - 11)) AS r(i)),
low AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), unnest(range(0, 13)) AS r(j) WHERE least < doc_id),
each AS (SELECT doc_id, p, words[p] AS word FROM w, unnest(range(1, len(words) + 1)) AS r(p)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS text
         FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
