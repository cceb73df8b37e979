"""The catalog's queries as ANSI SQL over the same tables, for cross-checking.

The SQL states the results row by row and takes no part in the Spark plans. Patterns
and fixed values are shared; regex flags differ between the two dialects.
"""

from __future__ import annotations

from ..functions import rules as R
from ..functions import text as X
from ..operators import decide as D
from ..operators import pairing as P
from ..sources import support_pairs_sql
from . import experiments as EX
from .catalog import BRANDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_of(texts) -> str:
    return " || chr(10) || ".join(map(q, texts))


def replace(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def clean(x: str) -> str:
    return f"trim({replace(replace(replace(x, X.URL_PATTERN), X.HANDLE_PATTERN), X.SPACES_PATTERN, ' ')})"


def strip(x: str) -> str:
    return replace(x, rf"^[{X.SPACE}]+|[{X.SPACE}]+$")


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)}, 'i')"


def first_match(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {hit(x, p)} THEN '{name}'" for name, p in rules)
    return f"CASE {whens} ELSE {default} END"


def intent(x: str = "customer_msg") -> str:
    return first_match(x, R.INTENT_RULES, "'other'")


def keyword(x: str = "customer_msg") -> str:
    return first_match(x, R.KEYWORD_RULES, "'other'")


def reason(x: str, label: str, score: str | None = None, low: float = 0.15) -> str:
    rest = f"CASE WHEN {label} = 'other' THEN 'unclassified_intent' ELSE 'none' END"
    if score:
        rest = f"CASE WHEN round({score}, 6) < {low} THEN 'low_retrieval_confidence' ELSE {rest} END"
    return first_match(x, R.ESCALATION_RULES, rest)


def keyword_reason(x: str = "customer_msg") -> str:
    return first_match(x, R.ESCALATION_RULES[:3], "'none'")


def canned(x: str) -> str:
    return f"CASE {x} " + " ".join(
        f"WHEN '{k}' THEN {q(v)}" for k, v in D.CANNED_REPLIES.items()
    ) + " END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(X.TOKEN_PATTERN)})"


def words(x: str) -> str:
    return f"len([w for w in string_split_regex({x}, {q(X.SPACES_PATTERN)}) if w <> ''])"


def terms(src: str, key: str, text: str, low: int = 1, high: int = 2, prefix: str = "") -> str:
    """(key, term) occurrences of word n-grams."""
    parts = []
    for n in range(low, high + 1):
        gram = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
        parts.append(
            f"SELECT {key}, {q(prefix)} || unnest([{gram} for i in range(1, len(t) - {n} + 2)]) AS term "
            f"FROM (SELECT {key}, {tokens(text)} AS t FROM {src})"
        )
    return " UNION ALL ".join(parts)


def char_terms(src: str, key: str, text: str, low: int, high: int, prefix: str = "") -> str:
    return (
        f"SELECT {key}, {q(prefix)} || substring(p, i, n) AS term FROM ("
        f"SELECT {key}, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM ("
        f"SELECT {key}, p, unnest(range(least({low}, length(p)), least({high}, length(p)) + 1)) AS n FROM ("
        f"SELECT {key}, ' ' || w || ' ' AS p FROM ("
        f"SELECT {key}, unnest(string_split_regex(lower({text}), {q(X.SPACES_PATTERN)})) AS w FROM {src})"
        f" WHERE w <> '')))"
    )


def tfidf(name: str, occurrences: str, key: str, n: str, min_df: int, block: str = "1") -> str:
    """CTEs <name>_tf, <name>_vocab and <name>_w (key, term, weight)."""
    return f"""
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM ({occurrences}) GROUP BY {key}, term),
{name}_vocab AS (SELECT term, count(*) AS df, ln((1.0 + {n}) / (1.0 + count(*))) + 1 AS idf
  FROM {name}_tf GROUP BY term HAVING count(*) >= {min_df}),
{weights(name + '_w', name + '_tf', name + '_vocab', key, block)}"""


def weights(name: str, tf: str, vocab: str, key: str, block: str = "1") -> str:
    return f"""{name} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key}, {block})) AS weight
  FROM (SELECT {key}, term, (1 + ln(tf)) * idf AS raw FROM {tf} JOIN {vocab} USING (term)))"""


TRANSCRIPTS = f"""
tr AS (SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'brand_' || (conv_id % 5) AS company,
  string_agg(CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Support' ELSE 'System' END
    || ': ' || text, chr(10) ORDER BY turn) AS conversation
  FROM conversations GROUP BY conv_id),
lines AS (SELECT conversation_id, unnest(string_split(conversation, chr(10))) AS line,
  generate_subscripts(string_split(conversation, chr(10)), 1) AS pos FROM tr),
stripped AS (SELECT conversation_id, pos, {strip('line')} AS line FROM lines),
turns AS (SELECT conversation_id,
  CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS BIGINT) AS turn,
  regexp_extract(line, '^(Customer|Support):', 1) AS role,
  regexp_extract(line, {q('(?s)^(?:Customer|Support):[' + X.SPACE + ']?(.*)$')}, 1) AS text
  FROM stripped WHERE regexp_matches(line, '^(Customer|Support):')),
tpairs AS (SELECT * FROM (SELECT conversation_id, turn, role, text AS customer_msg,
    lead(role) OVER w AS next_role, lead(text) OVER w AS support_reply
  FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY turn))
  WHERE role = 'Customer' AND next_role = 'Support')"""

TURN_PAIRS = """
cpairs AS (SELECT * FROM (SELECT conv_id AS conversation_id, turn, role, text AS customer_msg,
    lead(role) OVER w AS next_role, lead(text) OVER w AS support_reply
  FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
cok AS (SELECT * FROM (SELECT conversation_id, turn, {m} AS customer_msg, {r} AS support_reply FROM cpairs)
  WHERE length(customer_msg) >= 15 AND length(support_reply) >= 10)""".format(
    m=clean("customer_msg"), r=clean("support_reply")
)

PAIRS = f"""
sp AS ({support_pairs_sql()}),
cl AS (SELECT event_id AS pair_seq, conversation_id, {clean('customer_msg')} AS customer_msg,
  {clean('support_reply')} AS support_reply FROM sp),
ok AS (SELECT * FROM cl WHERE length(customer_msg) >= {P.MIN_MESSAGE} AND length(support_reply) >= {P.MIN_REPLY}),
dd AS (SELECT customer_msg, support_reply, min(pair_seq) AS pair_seq,
  arg_min(conversation_id, pair_seq) AS conversation_id FROM ok GROUP BY customer_msg, support_reply),
kept AS (SELECT 'p_' || md5(conversation_id || ':' || pair_seq) AS pair_id, conversation_id, pair_seq,
  customer_msg, support_reply FROM dd
  WHERE lower(support_reply) NOT IN ({', '.join(q(b) for b in P.BOILERPLATE_REPLIES)})),
placed AS (SELECT conversation_id, row_number() OVER (ORDER BY md5('42:' || conversation_id), conversation_id) AS place,
  count(*) OVER () AS n FROM (SELECT DISTINCT conversation_id FROM kept)),
chosen AS (SELECT conversation_id, CASE WHEN place <= n_eval THEN 'eval' WHEN place <= n_eval + n_dev THEN 'dev' END AS pool
  FROM (SELECT *, least(250, floor(CAST(n AS DOUBLE) * CAST(0.08 AS DOUBLE))) AS n_eval,
    least(400, floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE))) AS n_dev FROM placed)),
pooled AS (SELECT k.*, coalesce(c.pool, 'retrieval') AS pool FROM kept k LEFT JOIN chosen c USING (conversation_id)),
ev AS (SELECT * EXCLUDE (pool) FROM pooled WHERE pool = 'eval'
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY pair_seq) = 1),
dev AS (SELECT * FROM pooled WHERE pool = 'dev'),
ret AS (SELECT * FROM pooled WHERE pool = 'retrieval'),
gold AS (SELECT *, {reason('customer_msg', 'intent_label')} AS escalation_reason
  FROM (SELECT *, {intent()} AS intent_label FROM ev)),
majority AS (SELECT {intent()} AS label, count(*) AS n FROM dev GROUP BY 1 ORDER BY n DESC, label LIMIT 1)"""


def retrieval(queries: str) -> str:
    """CTEs ending in hits (customer_msg, rank, pair_id, ...) for distinct query texts."""
    return f"""{PAIRS},
{tfidf('c', terms('ret', 'pair_seq', 'customer_msg'), 'pair_seq', '(SELECT count(*) FROM ret)', 2)},
qt AS (SELECT DISTINCT customer_msg FROM {queries}),
q_tf AS (SELECT customer_msg, term, count(*) AS tf FROM ({terms('qt', 'customer_msg', 'customer_msg')}) GROUP BY 1, 2),
{weights('q_w', 'q_tf', 'c_vocab', 'customer_msg')},
sims AS (SELECT q.customer_msg, c.pair_seq, round(sum(q.weight * c.weight), 6) AS similarity
  FROM q_w q JOIN c_w c USING (term) GROUP BY q.customer_msg, c.pair_seq),
hits AS (SELECT s.customer_msg, rank, r.pair_id, r.pair_seq, r.customer_msg AS evidence_msg, r.support_reply, similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_msg ORDER BY similarity DESC, pair_seq) AS rank
    FROM sims WHERE similarity > 0) s JOIN ret r USING (pair_seq) WHERE rank <= 3)"""


def decisions(src: str, low_evidence: float = 0.12, low_score: float = 0.15) -> str:
    """CTE dec: the rows of ``src`` with evidence facts and decisions by rules."""
    sign_off = strip(replace("best", X.SIGN_OFF))
    return f"""
ev_rows AS (SELECT customer_msg, max(similarity) AS top_similarity, count(*) AS n_evidence,
    max(CASE WHEN rank = 1 THEN support_reply END) AS best,
    string_agg(support_reply, ' ' ORDER BY rank) AS replies,
    string_agg('[' || rank || '] ' || evidence_msg || ' => ' || support_reply, chr(10) ORDER BY rank) AS cases,
    string_agg('[' || rank || '] ' || support_reply, chr(10) ORDER BY rank) AS reply_list
  FROM hits GROUP BY customer_msg),
dec0 AS (SELECT s.*, {intent('s.customer_msg')} AS intent, coalesce(top_similarity, 0) AS top_sim,
    coalesce(n_evidence, 0) AS n_evidence, coalesce(top_similarity, 0) >= {low_evidence} AS grounded,
    CASE WHEN coalesce(top_similarity, 0) >= {low_evidence} THEN {sign_off} END AS draft_reply,
    coalesce(replies, '') AS replies, coalesce(cases, '') AS cases, coalesce(reply_list, '') AS reply_list
  FROM {src} s LEFT JOIN ev_rows USING (customer_msg)),
dec1 AS (SELECT *, {reason('customer_msg', 'intent', 'top_sim', low_score)} AS first_reason FROM dec0),
dec AS (SELECT *, reason_out <> 'none' AS escalate FROM (SELECT *,
  CASE WHEN first_reason = 'none' AND NOT grounded THEN 'insufficient_evidence' ELSE first_reason END AS reason_out FROM dec1))"""


def overlap(reply: str, evidence: str) -> str:
    def word_set(x: str) -> str:
        return f"list_distinct(regexp_extract_all(lower({x}), {q(X.WORD_PATTERN)}))"

    a, b = word_set(reply), word_set(evidence)
    return f"len(list_intersect({a}, {b})) / greatest(len({a}), 1)"


def claims(reply: str, evidence: str) -> str:
    found = f"list_distinct(regexp_extract_all({reply}, {q(X.CLAIM_PATTERN)}))"
    return (
        f"array_to_string(list_sort([c for c in {found} if NOT contains(lower({evidence}), lower(c))]), '|')"
    )


def class_report(src: str, by: str = "") -> str:
    """Report rows per label from counts (true_label, pred_label, n)."""
    b = f"{by}, " if by else ""
    return f"""SELECT {b}label, CASE WHEN p = 0 THEN 0.0 ELSE tp / p END AS precision,
  CASE WHEN s = 0 THEN 0.0 ELSE tp / s END AS recall,
  CASE WHEN p + s = 0 THEN 0.0 ELSE 2 * tp / (p + s) END AS f1, CAST(s AS BIGINT) AS support
FROM (SELECT {b}label, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(s) AS DOUBLE) AS s FROM (
  SELECT {b}true_label AS label, CASE WHEN true_label = pred_label THEN n ELSE 0 END AS tp, 0 AS p, n AS s FROM {src}
  UNION ALL SELECT {b}pred_label, 0, n, 0 FROM {src}) GROUP BY {b}label)"""


RULE_COUNTS = f"""rc AS (SELECT {intent()} AS true_label, {keyword()} AS pred_label, count(*) AS n
  FROM ({support_pairs_sql()}) GROUP BY 1, 2)"""

EVENTS = f"FROM ({support_pairs_sql()}) e"

PREDICTIONS = f"""
{retrieval('ev')},
{decisions('ev')},
preds AS (
  SELECT pair_id, 'baseline_trivial' AS system, intent_label, escalation_reason <> 'none' AS t,
    (SELECT label FROM majority) AS pred, false AS p FROM gold
  UNION ALL SELECT pair_id, 'baseline_simple', intent_label, escalation_reason <> 'none',
    {keyword()}, {keyword_reason()} <> 'none' FROM gold
  UNION ALL SELECT g.pair_id, 'system_full', g.intent_label, g.escalation_reason <> 'none', d.intent, d.escalate
    FROM gold g JOIN dec d USING (pair_id)),
pc AS (SELECT system, intent_label AS true_label, pred AS pred_label, count(*) AS n FROM preds GROUP BY ALL),
report AS ({class_report('pc', 'system')}),
esc AS (SELECT system, CAST(count_if(t AND p) AS DOUBLE) AS tp, CAST(count_if(NOT t AND p) AS DOUBLE) AS fp,
  CAST(count_if(t AND NOT p) AS DOUBLE) AS fn, CAST(count_if(NOT t AND NOT p) AS DOUBLE) AS tn FROM preds GROUP BY system),
sys AS (SELECT a.system, a.n, accuracy, macro_f1, weighted_f1, tp, fp, fn, tn
  FROM (SELECT system, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n) AS accuracy FROM pc GROUP BY system) a
  JOIN (SELECT system, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM report GROUP BY system) USING (system)
  JOIN esc USING (system))"""


def escalation_columns(digits: int | None = None) -> str:
    def r(x: str) -> str:
        return f"round({x}, {digits})" if digits else x

    return f"""{r('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS escalation_precision,
  {r('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS escalation_recall,
  {r('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS escalation_f1,
  CAST(fn AS BIGINT) AS false_auto_handle_count, {r('fn / greatest(tp + fn, 1)')} AS false_auto_handle_rate,
  CAST(fp AS BIGINT) AS false_escalation_count, {r('fp / greatest(fp + tn, 1)')} AS false_escalation_rate"""


def naive_bayes(p: str, train: str, test: str, chars: bool = False) -> str:
    """CTEs ending in <p>best (customer_msg, copies, true_label, pred, p, pred_o, p_o): a
    multinomial fit on ``train`` (pair_seq, customer_msg, label), applied to the distinct
    messages of ``test`` (customer_msg, label)."""

    def occurrences(src: str, key: str) -> str:
        if not chars:
            return terms(src, key, "customer_msg")
        words = terms(src, key, "customer_msg", prefix="w:")
        return words + " UNION ALL " + char_terms(src, key, "customer_msg", 3, 5, "c:")

    block = "substring(term, 1, 2)" if chars else "1"
    return f"""
{tfidf(p + 'm', occurrences(train, 'pair_seq'), 'pair_seq', f'(SELECT count(*) FROM {train})', 2, block)},
{p}prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM {train})) AS lp FROM {train} GROUP BY label),
{p}ct AS (SELECT label, term, sum(weight) AS s FROM {p}m_w JOIN {train} USING (pair_seq) GROUP BY label, term),
{p}tot AS (SELECT label, coalesce(sum(s), 0) + (SELECT count(*) FROM {p}m_vocab) AS z
  FROM {p}prior LEFT JOIN {p}ct USING (label) GROUP BY label),
{p}dm AS (SELECT customer_msg, count(*) AS copies, min(label) AS label FROM {test} GROUP BY customer_msg),
{p}d_tf AS (SELECT customer_msg, term, count(*) AS tf FROM ({occurrences(p + 'dm', 'customer_msg')}) GROUP BY 1, 2),
{weights(p + 'd_w', p + 'd_tf', p + 'm_vocab', 'customer_msg', block)},
{p}lin AS (SELECT d.customer_msg, p.label, sum(d.weight * (ln(coalesce(ct.s, 0) + 1) - ln(z))) AS dot
  FROM {p}d_w d CROSS JOIN {p}prior p JOIN {p}tot USING (label)
  LEFT JOIN {p}ct ct ON ct.label = p.label AND ct.term = d.term GROUP BY 1, 2),
{p}scored AS (SELECT dm.customer_msg, dm.copies, dm.label AS true_label, p.label AS pred, lp + coalesce(dot, 0) AS score
  FROM {p}dm dm CROSS JOIN {p}prior p LEFT JOIN {p}lin lin ON lin.customer_msg = dm.customer_msg AND lin.label = p.label),
{p}prob AS (SELECT *, exp(score - max(score) OVER m) / sum(exp(score - mx)) OVER m AS p
  FROM (SELECT *, max(score) OVER (PARTITION BY customer_msg) AS mx FROM {p}scored) WINDOW m AS (PARTITION BY customer_msg)),
{p}best AS (SELECT customer_msg, copies, true_label, arg_max(pred, p) AS pred, max(p) AS p,
  arg_max(pred, p) FILTER (pred <> 'other') AS pred_o, max(p) FILTER (pred <> 'other') AS p_o FROM {p}prob GROUP BY ALL)"""


NAIVE_BAYES = f"""{PAIRS},
tp AS (SELECT pair_seq, customer_msg, {intent()} AS label FROM pooled WHERE pool <> 'eval'),
dl AS (SELECT customer_msg, {intent()} AS label FROM dev),
{naive_bayes('', 'tp', 'dl')}"""

HASHED = f"""{PAIRS},
ht AS (SELECT pair_seq, term, count(*) AS tf FROM ({terms('kept', 'pair_seq', 'customer_msg', prefix='w:')}
  UNION ALL {char_terms('kept', 'pair_seq', 'customer_msg', 3, 5, 'c:')}) GROUP BY ALL),
hx AS (SELECT *, CAST(CAST('0x' || left(md5(term), 8) AS BIGINT) % 4096 AS INT) AS index,
  CASE WHEN substring(md5(term), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM ht)"""

TRANSCRIPT_POOLS = f"""{TRANSCRIPTS},
tcl AS (SELECT p.conversation_id, turn, {clean('customer_msg')} AS customer_msg, {clean('support_reply')} AS support_reply
  FROM tpairs p JOIN tr USING (conversation_id) WHERE company = 'brand_1'),
tok AS (SELECT * FROM tcl WHERE length(customer_msg) >= 15 AND length(support_reply) >= 10),
tkept AS (SELECT * FROM (SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY customer_msg, support_reply
    ORDER BY conversation_id, turn) = 1)
  WHERE lower(support_reply) NOT IN ({', '.join(q(b) for b in P.BOILERPLATE_REPLIES)})),
tplaced AS (SELECT conversation_id, row_number() OVER (ORDER BY md5('42:' || conversation_id), conversation_id) AS place,
  CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT DISTINCT conversation_id FROM tkept)),
tpooled AS (SELECT k.*, CASE WHEN place <= least(250, floor(n * CAST(0.08 AS DOUBLE))) THEN 'eval'
  WHEN place <= least(250, floor(n * CAST(0.08 AS DOUBLE))) + least(400, floor(n * CAST(0.1 AS DOUBLE))) THEN 'dev'
  ELSE 'retrieval' END AS pool FROM tkept k JOIN tplaced USING (conversation_id))"""

# the dev pool cut 80 : 20 within every label, and the same with the retrieval pool to train
SPLIT = f"""{PAIRS},
dk AS (SELECT pair_id, pair_seq, customer_msg, {intent()} AS label FROM dev),
cut AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || pair_id), pair_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2) AS held FROM dk),
small AS (SELECT pair_id, pair_seq, customer_msg, label FROM cut WHERE NOT held),
held AS (SELECT customer_msg, label FROM cut WHERE held),
large AS (SELECT * FROM small UNION ALL SELECT pair_id, pair_seq, customer_msg, {intent()} FROM ret),
placed_rows AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) AS place, count(*) OVER () AS n_all FROM large),
glab AS (SELECT customer_msg, {intent()} AS label FROM ev)"""


def counts_of(best: str) -> str:
    return f"SELECT true_label, pred AS pred_label, CAST(sum(copies) AS BIGINT) AS n FROM {best} GROUP BY ALL"


def summary(counts: str, by: str) -> str:
    """Rows (by, n, accuracy, macro_f1, weighted_f1) from counts."""
    return f"""SELECT {by}, n, accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM
  (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n) AS accuracy
    FROM {counts} GROUP BY {by}) JOIN
  (SELECT {by}, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM ({class_report(counts, by)}) GROUP BY {by}) USING ({by})"""


GAP = f"""{SPLIT},
{naive_bayes('t_', 'small', 'small')},
{naive_bayes('h_', 'small', 'held')},
{naive_bayes('g_', 'small', 'glab')},
gc AS (SELECT 'train' AS split, * FROM ({counts_of('t_best')}) UNION ALL
  SELECT 'dev', * FROM ({counts_of('h_best')}) UNION ALL SELECT 'golden', * FROM ({counts_of('g_best')}))"""

WORD_CHAR = f"""{SPLIT},
{naive_bayes('a_', 'small', 'held')},
{naive_bayes('b_', 'small', 'held', chars=True)},
wc AS (SELECT 'word' AS config, * FROM ({counts_of('a_best')}) UNION ALL
  SELECT 'word+char', * FROM ({counts_of('b_best')})),
wcs AS ({summary('wc', 'config')}),
tried AS (SELECT CAST(CASE config WHEN 'word' THEN 0 ELSE 1 END AS INT) AS step, 'features' AS grp, * FROM wcs)"""


def learning_curve() -> str:
    cut = "place <= floor(CAST(n_all AS DOUBLE) * CAST({} AS DOUBLE))"
    parts, counts = [], []
    for i, share in enumerate(EX.FRACTIONS):
        parts.append(f"lc{i} AS (SELECT pair_seq, customer_msg, label FROM placed_rows WHERE {cut.format(share)})")
        parts.append(naive_bayes(f"l{i}_", f"lc{i}", "held"))
        counts.append(f"SELECT {i} AS step, * FROM ({counts_of(f'l{i}_best')})")
    sizes = ", ".join(
        f"({i}, '{share:.2f}', (SELECT count(*) FROM lc{i}))" for i, share in enumerate(EX.FRACTIONS)
    )
    return with_(
        f"{SPLIT}, {', '.join(parts)}, lcc AS ({' UNION ALL '.join(counts)})",
        f"SELECT CAST(step AS INT) AS step, 'fraction' AS grp, config, n, accuracy, macro_f1, weighted_f1, n_train "
        f"FROM ({summary('lcc', 'step')}) JOIN (VALUES {sizes}) v(step, config, n_train) USING (step)",
    )


def prefix_vocabulary() -> str:
    cut = "place <= floor(CAST(n_all AS DOUBLE) * CAST({} AS DOUBLE))"
    rows = " UNION ALL ".join(
        f"SELECT term, CAST({s} AS DOUBLE) AS share, count(*) AS df FROM pt JOIN placed_rows USING (pair_seq) "
        f"WHERE {cut.format(s)} GROUP BY term HAVING count(*) >= 2"
        for s in EX.FRACTIONS
    )
    return with_(
        f"{SPLIT}, pt AS (SELECT DISTINCT pair_seq, term FROM ({terms('large', 'pair_seq', 'customer_msg')}))", rows
    )


def shared_grams() -> str:
    rows = []
    for name, f in EX.FEATURE_GRID:
        found = terms("small", "pair_seq", "customer_msg", *f.word, prefix="w:")
        if f.char:
            found += " UNION ALL " + char_terms("small", "pair_seq", "customer_msg", *f.char, "c:")
        rows.append(
            f"SELECT {q(name)} AS config, count(*) AS terms, CAST(sum(df) AS BIGINT) AS df FROM (SELECT term, "
            f"count(DISTINCT pair_seq) AS df FROM ({found}) GROUP BY term HAVING count(DISTINCT pair_seq) >= {f.min_df})"
        )
    return with_(SPLIT, " UNION ALL ".join(rows))


def with_(ctes: str, final: str) -> str:
    return f"WITH {ctes} {final}"


def oracle_queries() -> dict[str, str]:
    doc_n = "(SELECT count(*) FROM documents)"
    sql: dict[str, str] = {
        "a1_parquet_scan": "SELECT conv_id, turn, role, text FROM conversations",
        "a2_csv_round_trip": with_(PAIRS, "SELECT * FROM kept"),
        "a3_pool_sink": with_(PAIRS, "SELECT pair_id, conversation_id, customer_msg, support_reply, pool FROM pooled"),
        "a5_model_round_trip": with_(PAIRS, "SELECT pair_id, true AS same FROM dev"),
        "a4_json_report": with_(
            PREDICTIONS,
            "SELECT s.system, s.n, round(accuracy, 4) AS intent_accuracy, round(macro_f1, 4) AS intent_macro_f1, "
            "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS escalation_f1, "
            "label, round(f1, 4) AS f1 FROM sys s JOIN report USING (system)",
        ),
        "a6_index_round_trip": with_(
            retrieval("ev"),
            "SELECT pair_id, customer_msg, support_reply, term, df, round(idf, 6) AS idf, round(weight, 6) AS weight, "
            "round(max(weight) OVER (PARTITION BY term), 6) AS peak, true AS bounded "
            "FROM c_w JOIN c_vocab USING (term) JOIN ret USING (pair_seq)",
        ),
        "b1_brand_filter": with_(
            TRANSCRIPTS,
            "SELECT conversation_id, company, length(conversation) AS n_chars FROM tr WHERE company = 'brand_1'",
        ),
        "b2_candidate_filter": with_(
            TRANSCRIPTS,
            f"SELECT company, count(*) AS n FROM tr WHERE company IN {BRANDS} GROUP BY company",
        ),
        "b3_min_length": with_(TURN_PAIRS, "SELECT conversation_id, turn, customer_msg, support_reply FROM cok"),
        "b4_boilerplate": with_(
            PAIRS,
            "SELECT support_reply, count(*) AS n FROM ok WHERE lower(support_reply) NOT IN "
            f"({', '.join(q(b) for b in P.BOILERPLATE_REPLIES)}) GROUP BY 1",
        ),
        "b5_other_class": f"SELECT event_id, customer_msg {EVENTS} WHERE {intent()} = 'other'",
        "b7_projection": with_(PAIRS, "SELECT pair_id, customer_msg FROM kept"),
        "b8_cast_bool": "SELECT doc_id, CAST(quality AS BOOLEAN) AS quality, CAST(toxic AS BOOLEAN) AS toxic FROM labels",
        "c1_clean_documents": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
        "c1_clean_messages": f"SELECT event_id, {clean('customer_msg')} AS cleaned {EVENTS}",
        "c2_transcript_lines": with_(TRANSCRIPTS, "SELECT conversation_id, turn, role, text FROM turns"),
        "c3_has_reply": with_(
            TRANSCRIPTS,
            "SELECT conversation_id, starts_with(conversation, 'Support:') OR "
            "contains(conversation, chr(10) || 'Support:') AS replied FROM tr",
        ),
        "c4_turn_count": with_(
            TRANSCRIPTS,
            "SELECT conversation_id, CAST(count_if(regexp_matches(line, '^(Customer|Support):')) AS BIGINT) AS turns "
            "FROM lines GROUP BY conversation_id",
        ),
        "c5_intent_rules": f"SELECT event_id, {intent()} AS intent {EVENTS}",
        "c5_intent_turns": f"SELECT conv_id, turn, {intent('text')} AS intent FROM conversations",
        "c5_intent_documents": f"SELECT doc_id, {intent('text')} AS intent FROM documents",
        "c6_escalation": f"SELECT event_id, reason, reason <> 'none' AS escalate FROM (SELECT event_id, "
                         f"{reason('customer_msg', 'intent')} AS reason FROM (SELECT *, {intent()} AS intent {EVENTS}))",
        "c6_escalation_with_score":
            f"SELECT event_id, {reason('customer_msg', 'intent', 'score')} AS reason FROM "
            f"(SELECT e.*, {intent()} AS intent, v.value / 100 AS score {EVENTS} "
            "JOIN events v USING (event_id))",
        "c7_rule_hits": "SELECT event_id, concat_ws(',', "
                        + ", ".join(f"CASE WHEN {hit('customer_msg', p)} THEN '{n}' END" for n, p in R.INTENT_RULES)
                        + f") AS hits {EVENTS}",
        "c8_keyword_rules": f"SELECT event_id, {keyword()} AS intent {EVENTS}",
        "c9_sign_off": f"SELECT event_id, {strip(replace('support_reply', X.SIGN_OFF))} AS reply {EVENTS}",
        "c10_word_tokens": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
        "c11_word_ngrams": f"SELECT term, count(*) AS n FROM ({terms('documents', 'doc_id', 'text', 1, 3)}) GROUP BY term",
        "c12_char_ngrams": f"SELECT term, count(*) AS n FROM ({char_terms('documents', 'doc_id', 'text', 3, 5)}) GROUP BY term",
        "c12_char_ngrams_short_words": with_(
            PAIRS,
            f"SELECT term, count(*) AS n FROM ({char_terms('kept', 'pair_id', 'customer_msg', 4, 6)}) GROUP BY term",
        ),
        "c13_word_count": f"SELECT doc_id, {words('text')} AS words, {words('text')} <= 5 AS fragment FROM documents",
        "c14_reply_length": with_(
            TURN_PAIRS,
            f"SELECT conversation_id, turn, {words('support_reply')} BETWEEN 10 AND 80 AS length_ok FROM cpairs",
        ),
        "c15_word_overlap": with_(
            TURN_PAIRS,
            f"SELECT conversation_id, turn, round({overlap('support_reply', 'customer_msg')}, 6) AS overlap FROM cpairs",
        ),
        "c16_unsupported_claims": f"SELECT event_id, {claims('support_reply', 'customer_msg')} AS claims {EVENTS}",
        "c17_duplicate_key": f"SELECT {strip('lower(text)')} AS dup_key, count(*) AS n FROM documents GROUP BY 1",
        "c18_near_duplicate_key":
            "SELECT doc_id, " + replace("lower(text)", rf"[^\p{{L}}\p{{N}}{X.SPACE}]") + " AS near_key FROM documents",
        "c19_preview": "SELECT doc_id, substring(text, 1, 80) AS preview FROM documents",
        "c20_pair_ids": with_(PAIRS, "SELECT * FROM kept"),
        "c20_dense_ids": with_(
            PAIRS,
            "SELECT printf('sp_%06d', row_number() OVER (ORDER BY pair_seq) - 1) AS row_id, pair_id FROM kept",
        ),
        "c22_prompts": with_(
            retrieval("ev") + "," + decisions("ev"),
            "SELECT pair_id, CASE WHEN grounded THEN 'PRECEDENTS' || chr(10) || cases || chr(10) || 'MESSAGE' || chr(10) "
            f"|| customer_msg || chr(10) || 'RULES' || chr(10) || {lines_of(D.REPLY_RULES)} || chr(10) END AS reply_prompt, "
            "'PRECEDENTS' || chr(10) || reply_list || chr(10) || 'MESSAGE' || chr(10) || customer_msg || chr(10) "
            "|| 'REPLY' || chr(10) || coalesce(draft_reply, '') || chr(10) || 'SCORES 1-5' || chr(10) "
            f"|| {lines_of(d + ': ?' for d in D.REVIEW_DIMENSIONS)} || chr(10) AS review_prompt FROM dec",
        ),
        "d1_pairs_from_transcripts": with_(
            TRANSCRIPTS,
            "SELECT conversation_id, turn, c AS customer_msg, s AS support_reply FROM (SELECT conversation_id, turn, "
            f"{clean('customer_msg')} AS c, {clean('support_reply')} AS s FROM tpairs) WHERE length(c) >= 15 AND length(s) >= 10",
        ),
        "d2_pairs_from_turns": with_(
            TURN_PAIRS, "SELECT conversation_id, turn, customer_msg, support_reply FROM cpairs"
        ),
        "d2_pairs_per_intent": with_(TURN_PAIRS, f"SELECT {intent()} AS intent, count(*) AS n FROM cok GROUP BY 1"),
        "d3_pairs_per_conversation": with_(
            TRANSCRIPTS, "SELECT conversation_id, count(*) AS pairs FROM tpairs GROUP BY 1"
        ),
        "e1_semi_join": with_(PAIRS, "SELECT pair_id, conversation_id FROM kept WHERE conversation_id IN "
                                     "(SELECT conversation_id FROM chosen WHERE pool = 'dev')"),
        "e2_anti_join": with_(PAIRS, "SELECT pair_id, conversation_id FROM kept WHERE conversation_id NOT IN "
                                     "(SELECT conversation_id FROM chosen WHERE pool IS NOT NULL)"),
        "e3_predictions_join": with_(
            PAIRS,
            f"SELECT pair_id, customer_msg, intent_label, {keyword()} AS pred_intent, "
            f"{keyword_reason()} <> 'none' AS pred_escalate FROM gold",
        ),
        "e4_topk_retrieval": with_(retrieval("ev"), "SELECT customer_msg, rank, pair_id, similarity FROM hits"),
        "e4_topk_all_messages": with_(retrieval("pooled"), "SELECT customer_msg, rank, pair_id, similarity FROM hits"),
        "e5_evidence_lookup": with_(
            retrieval("ev"), "SELECT customer_msg, pair_id, evidence_msg, support_reply FROM hits"
        ),
        "e6_canned_reply": f"SELECT event_id, {canned(keyword())} AS reply {EVENTS}",
        "e7_leakage_check": with_(
            PAIRS,
            " UNION ALL ".join(
                f"SELECT '{a}' AS pool_a, '{b}' AS pool_b, count(*) AS shared FROM (SELECT conversation_id FROM pooled "
                f"WHERE pool = '{a}' INTERSECT SELECT conversation_id FROM pooled WHERE pool = '{b}')"
                for a, b in (("eval", "dev"), ("eval", "retrieval"), ("dev", "retrieval"))
            ),
        ),
        "f1_brand_profile": with_(
            TRANSCRIPTS,
            """SELECT company AS brand, count(*) AS n_conversations,
  round(avg(CASE WHEN starts_with(conversation, 'Support:') OR contains(conversation, chr(10) || 'Support:') THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct_with_support_reply,
  round(avg(n), 2) AS avg_turns FROM tr JOIN (SELECT conversation_id,
    count_if(regexp_matches(line, '^(Customer|Support):')) AS n FROM lines GROUP BY 1) USING (conversation_id) GROUP BY company""",
        ),
        "f3_dedupe": with_(PAIRS, "SELECT customer_msg, support_reply, pair_seq, conversation_id FROM dd"),
        "f4_first_per_conversation": with_(
            PAIRS, "SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY pair_seq) = 1"
        ),
        "f5_class_counts": with_(PAIRS, f"SELECT {intent()} AS intent, count(*) AS n FROM kept GROUP BY 1"),
        "f6_flag_share":
            f"SELECT intent, CAST(count_if(r <> 'none') AS BIGINT) AS escalated, count(*) AS n, "
            f"avg(CASE WHEN r <> 'none' THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT intent, "
            f"{reason('customer_msg', 'intent')} AS r FROM (SELECT *, {intent()} AS intent {EVENTS})) GROUP BY intent",
        "f7_word_count_profile": word_profile("documents", "text"),
        "f8_duplicates":
            f"SELECT count(*) AS n, count(*) - count(DISTINCT {strip('lower(customer_msg)')}) AS duplicates {EVENTS}",
        "f9_confusion_matrix": with_(
            RULE_COUNTS + ", l AS (SELECT true_label AS label FROM rc UNION SELECT pred_label FROM rc)",
            "SELECT a.label AS true_label, b.label AS pred_label, coalesce(n, 0) AS n FROM l a CROSS JOIN l b "
            "LEFT JOIN rc ON rc.true_label = a.label AND rc.pred_label = b.label",
        ),
        "f11_class_report": with_(RULE_COUNTS, class_report("rc")),
        "f12_accuracy_macro_weighted": with_(
            RULE_COUNTS + f", rep AS ({class_report('rc')})",
            "SELECT (SELECT CAST(sum(n) AS BIGINT) FROM rc) AS n, "
            "(SELECT sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n) FROM rc) AS accuracy, "
            "round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep",
        ),
        "f13_f14_escalation_metrics":
            f"SELECT {escalation_columns()} FROM (SELECT CAST(count_if(t AND p) AS DOUBLE) AS tp, "
            "CAST(count_if(NOT t AND p) AS DOUBLE) AS fp, CAST(count_if(t AND NOT p) AS DOUBLE) AS fn, "
            f"CAST(count_if(NOT t AND NOT p) AS DOUBLE) AS tn FROM (SELECT {reason('customer_msg', 'intent')} <> 'none' AS t, "
            f"{keyword_reason()} <> 'none' AS p FROM (SELECT *, {intent()} AS intent {EVENTS})))",
        "f15_judge_summary": with_(
            judged(),
            "SELECT 'heuristic' AS judge_method, count(*) AS n, CAST(sum(grounded_score) AS BIGINT) AS grounded_count, "
            "CAST(count_if(length_ok) AS BIGINT) AS length_ok_count, "
            "CAST(count_if(unsupported_claims <> '') AS BIGINT) AS replies_with_unsupported_claims FROM judged",
        ),
        "f16_stage_counts": with_(
            PAIRS,
            "SELECT 'raw_conversations' AS step, count(DISTINCT conversation_id) AS n FROM sp "
            "UNION ALL SELECT 'extracted_pairs', count(*) FROM ok UNION ALL SELECT 'deduped_pairs', count(*) FROM kept "
            "UNION ALL SELECT 'eval_pool', count(*) FROM ev UNION ALL SELECT 'dev_pool', count(*) FROM dev "
            "UNION ALL SELECT 'retrieval_corpus', count(*) FROM ret",
        ),
        "f17_vocabulary": with_(
            tfidf("d", terms("documents", "doc_id", "text"), "doc_id", doc_n, 2),
            "SELECT term, df, round(idf, 6) AS idf FROM d_vocab",
        ),
        "f18_document_norms": with_(
            tfidf("d", terms("documents", "doc_id", "text", 1, 1), "doc_id", doc_n, 1),
            "SELECT doc_id, round(sqrt(sum(r * r)), 6) AS norm FROM (SELECT doc_id, (1 + ln(tf)) * idf AS r "
            "FROM d_tf JOIN d_vocab USING (term)) GROUP BY doc_id",
        ),
        "f19_class_weights":
            f"SELECT label, n, round((sum(n) OVER ()) / (count(*) OVER () * n), 6) AS class_weight FROM "
            f"(SELECT {intent()} AS label, count(*) AS n {EVENTS} GROUP BY 1)",
        "f20_majority_class":
            f"SELECT {intent()} AS intent, count(*) AS n {EVENTS} GROUP BY 1 ORDER BY n DESC, intent LIMIT 1",
        "f21_kappa_intents": with_(
            RULE_COUNTS + ", tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM rc)",
            "SELECT CAST(t AS BIGINT) AS n, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT t, "
            "(SELECT sum(n) FROM rc WHERE true_label = pred_label) / t AS po, "
            "(SELECT sum(a.n * b.n) FROM (SELECT true_label AS l, sum(n) AS n FROM rc GROUP BY 1) a JOIN "
            "(SELECT pred_label AS l, sum(n) AS n FROM rc GROUP BY 1) b USING (l)) / (t * t) AS pe FROM tot)",
        ),
        "f21_weighted_kappa_spearman": """
WITH c AS (SELECT count(*) AS n, avg(power(quality - toxic, 2)) AS seen FROM labels),
e AS (SELECT avg(power(a.quality - b.toxic, 2)) AS expected FROM labels a CROSS JOIN labels b),
r AS (SELECT rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS rq,
  rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0 AS rt FROM labels)
SELECT n, round(1 - seen / expected, 6) AS kappa, (SELECT round(corr(rq, rt), 6) FROM r) AS spearman FROM c, e""",
        "f21_spearman_long_scale": """
WITH r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
  FROM (SELECT l_extendedprice AS a, l_quantity * l_discount AS b FROM lineitem))
SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r""",
        "h3_seeded_shuffle":
            "SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS place FROM events",
        "h4_seeded_sample": with_(
            PAIRS, "SELECT pair_id, customer_msg FROM kept ORDER BY md5('42:' || pair_id), pair_id LIMIT 40"
        ),
        "h5_prefix_fraction": "SELECT event_id, CASE "
        + " ".join(
            f"WHEN r <= floor(CAST(n AS DOUBLE) * CAST({s} AS DOUBLE)) THEN CAST({s} AS DOUBLE)" for s in EX.FRACTIONS
        )
        + " END AS prefix_share FROM (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS r, "
          "count(*) OVER () AS n FROM events)",
        "h6_multi_rule_examples": with_(
            PAIRS,
            "SELECT pair_id, substring(customer_msg, 1, 80) AS preview, hits FROM (SELECT *, concat_ws(',', "
            + ", ".join(f"CASE WHEN {hit('customer_msg', p)} THEN '{n}' END" for n, p in R.INTENT_RULES)
            + ") AS hits FROM kept) WHERE contains(hits, ',') ORDER BY pair_id LIMIT 8",
        ),
        "i1_union_all": with_(
            PAIRS,
            "SELECT customer_msg, count(*) AS n FROM (SELECT customer_msg FROM dev UNION ALL SELECT customer_msg FROM ret) GROUP BY 1",
        ),
        "i2_intersect":
            f"SELECT conversation_id {EVENTS} WHERE {intent()} = 'billing_subscription' INTERSECT "
            f"SELECT conversation_id {EVENTS} WHERE {intent()} = 'playback_technical'",
        "i4_label_union": with_(RULE_COUNTS, "SELECT true_label AS label FROM rc UNION SELECT pred_label FROM rc"),
        "j1_pools": with_(PAIRS, "SELECT pair_id, conversation_id, pool FROM pooled"),
        "j1_eval_pool": with_(PAIRS, "SELECT * FROM ev"),
        "j2_stratified_split":
            "SELECT event_id, intent, CASE WHEN r <= round(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM "
            "(SELECT event_id, intent, row_number() OVER (PARTITION BY intent ORDER BY md5('42:' || event_id), event_id) AS r, "
            f"count(*) OVER (PARTITION BY intent) AS n FROM (SELECT event_id, {intent()} AS intent {EVENTS}))",
        "k1_tfidf_documents": with_(
            tfidf("d", terms("documents", "doc_id", "text", 1, 1), "doc_id", doc_n, 2),
            "SELECT doc_id, term, round(weight, 6) AS weight FROM d_w",
        ),
        "k2_transform_unseen": with_(
            tfidf("d", terms("documents", "doc_id", "text", 1, 1), "doc_id", doc_n, 2)
            + ", tq AS (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations)"
            + f", t_tf AS (SELECT doc_id, term, count(*) AS tf FROM ({terms('tq', 'doc_id', 'text', 1, 1)}) GROUP BY 1, 2), "
            + weights("t_w", "t_tf", "d_vocab", "doc_id"),
            "SELECT doc_id, term, round(weight, 6) AS weight FROM t_w",
        ),
        "k3_feature_union": with_(
            PAIRS + ","
            + tfidf(
                "u",
                terms("kept", "pair_seq", "customer_msg", prefix="w:")
                + " UNION ALL " + char_terms("kept", "pair_seq", "customer_msg", 3, 5, "c:"),
                "pair_seq", "(SELECT count(*) FROM kept)", 2, "substring(term, 1, 2)",
            ),
            "SELECT pair_seq AS doc_id, term, round(weight, 6) AS weight FROM u_w",
        ),
        "k6_naive_bayes": with_(NAIVE_BAYES, "SELECT customer_msg, pred AS intent FROM best"),
        "k7_confidence": with_(NAIVE_BAYES, "SELECT customer_msg, round(p, 5) AS confidence FROM best"),
        "k8_override": with_(
            NAIVE_BAYES
            + ", th AS (SELECT CAST(unnest([0.0, "
            + ", ".join(map(str, EX.OVERRIDE_THRESHOLDS))
            + "]) AS DOUBLE) AS threshold), "
            "op AS (SELECT threshold, true_label, CASE WHEN threshold > 0 AND p_o >= threshold THEN pred_o ELSE pred END AS pred_label, "
            "sum(copies) AS n FROM best CROSS JOIN th GROUP BY ALL), "
            f"orep AS ({class_report('op', 'threshold')})",
            "SELECT threshold, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n) AS accuracy, "
            "(SELECT round(avg(f1), 6) FROM orep WHERE orep.threshold = op.threshold) AS macro_f1 FROM op GROUP BY threshold",
        ),
        "k8_override_report": with_(
            f"{SPLIT}, {naive_bayes('', 'small', 'held')}, th AS (SELECT CAST(unnest([0.0, "
            + ", ".join(map(str, EX.OVERRIDE_THRESHOLDS))
            + "]) AS DOUBLE) AS threshold), "
            "op AS (SELECT threshold, true_label, CASE WHEN threshold > 0 AND p_o >= threshold THEN pred_o ELSE pred END AS pred_label, "
            f"sum(copies) AS n FROM best CROSS JOIN th GROUP BY ALL), r AS ({summary('op', 'threshold')})",
            "SELECT threshold, n, accuracy, macro_f1, threshold = (SELECT threshold FROM r ORDER BY macro_f1 DESC, threshold LIMIT 1) AS chosen FROM r",
        ),
        "k4_linear_svc": with_(PAIRS, f"SELECT {intent()} AS label, count(*) AS n, true AS converged, true AS good FROM ev GROUP BY 1"),
        "k5_logistic_regression": with_(PAIRS, f"SELECT {intent()} AS label, count(*) AS n, true AS converged, true AS good FROM ev GROUP BY 1"),
        "k9_gap_report": with_(GAP, summary("gc", "split")),
        "k9_gap_classes": with_(GAP, class_report("gc", "split")),
        "k9_gap_matrix": with_(
            GAP,
            "SELECT a.split, a.l AS true_label, b.l AS pred_label, coalesce(n, 0) AS n FROM "
            "(SELECT split, true_label AS l FROM gc UNION SELECT split, pred_label FROM gc) a JOIN "
            "(SELECT split, true_label AS l FROM gc UNION SELECT split, pred_label FROM gc) b ON a.split = b.split "
            "LEFT JOIN gc ON gc.split = a.split AND gc.true_label = a.l AND gc.pred_label = b.l",
        ),
        "k10_learning_curve": learning_curve(),
        "k10_prefix_vocabulary": prefix_vocabulary(),
        "k11_grid": with_(SPLIT, "SELECT CAST(i AS INT) AS step, (SELECT count(*) FROM held) AS n, true AS good FROM range(23) t(i)"),
        "k11_shared_grams": shared_grams(),
        "k12_svc_sweep": with_(
            SPLIT,
            "SELECT CAST(i AS INT) AS step, 'svc C=' || ['0.5', '1', '2'][i % 3 + 1] || CASE WHEN i < 3 THEN ' unweighted' ELSE ' balanced' END "
            "AS config, (SELECT count(*) FROM held) AS n, true AS good FROM range(6) t(i)",
        ),
        "k13_word_or_char": with_(WORD_CHAR, "SELECT * FROM tried"),
        "h7_best_config": with_(WORD_CHAR, "SELECT * FROM tried ORDER BY macro_f1 DESC, step LIMIT 1"),
        "l2_decisions_with_model": with_(
            retrieval("ev") + "," + decisions("ev"), "SELECT pair_id, draft_reply, grounded, true AS follows FROM dec"
        ),
        "full_run": with_(
            PREDICTIONS,
            "SELECT system, n, true AS good, CASE WHEN system <> 'system_full' THEN round(accuracy, 6) END AS intent_accuracy, "
            "CASE WHEN system <> 'system_full' THEN round(macro_f1, 6) END AS intent_macro_f1, "
            "CASE WHEN system <> 'system_full' THEN round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) END "
            "AS escalation_f1 FROM sys",
        ),
        "k5_hashed_features": with_(
            HASHED,
            "SELECT pair_seq AS doc_id, index, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY pair_seq)), 6) AS weight "
            "FROM (SELECT pair_seq, index, sum(sign * (1 + ln(tf))) AS raw FROM hx GROUP BY ALL) WHERE abs(raw) > 1e-12",
        ),
        "k5_hash_collisions": with_(
            HASHED,
            "SELECT CAST(sum(n) AS BIGINT) AS terms, count(*) AS indexes, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS shared "
            "FROM (SELECT index, count(DISTINCT term) AS n FROM hx GROUP BY index)",
        ),
        "d3_prepared_pools": with_(
            TRANSCRIPT_POOLS,
            "SELECT 'p_' || md5(conversation_id || ':' || turn) AS pair_id, conversation_id, customer_msg, support_reply, pool FROM tpooled",
        ),
        "f16_observed_counts": with_(
            TRANSCRIPT_POOLS,
            "SELECT 'raw_conversations' AS step, count(*) AS n FROM tr WHERE company = 'brand_1' "
            "UNION ALL SELECT 'extracted_pairs', count(*) FROM tok UNION ALL SELECT 'deduped_pairs', count(*) FROM tkept "
            "UNION ALL SELECT 'eval_pool', count(DISTINCT conversation_id) FROM tpooled WHERE pool = 'eval' "
            "UNION ALL SELECT 'dev_pool', count(*) FROM tpooled WHERE pool = 'dev' "
            "UNION ALL SELECT 'retrieval_corpus', count(*) FROM tpooled WHERE pool = 'retrieval'",
        ),
        "f2_vocab_sketch": with_(
            TRANSCRIPTS,
            f"SELECT company AS brand, count(*) AS words, true AS within_4_percent FROM (SELECT company, "
            f"unnest(string_split_regex(lower(conversation), {q(X.SPACES_PATTERN)})) AS w FROM tr) WHERE w <> '' GROUP BY 1",
        ),
        "k14_training_pool": with_(
            PAIRS, f"SELECT {intent()} AS intent_label, count(*) AS n FROM pooled WHERE pool <> 'eval' GROUP BY 1"
        ),
        "l1_extractive_reply": with_(
            retrieval("ev") + "," + decisions("ev"), "SELECT pair_id, draft_reply, grounded FROM dec"
        ),
        "l2_decisions": with_(
            retrieval("ev") + "," + decisions("ev"),
            "SELECT pair_id, intent, draft_reply, grounded, escalate, reason_out AS escalation_reason, "
            "n_evidence, round(top_sim, 6) AS top_similarity FROM dec",
        ),
        "l2_decisions_all_events": with_(
            retrieval("sp") + "," + decisions("sp", 0.9, 0.5),
            "SELECT event_id, intent, grounded, escalate, reason_out AS escalation_reason FROM dec",
        ),
        "l3_trivial_baseline": with_(
            PAIRS,
            f"SELECT pair_id, label AS intent, {canned('label')} AS draft_reply, false AS escalate, "
            "'none' AS escalation_reason FROM ev CROSS JOIN majority",
        ),
        "l4_keyword_baseline":
            f"SELECT event_id, intent, {canned('intent')} AS draft_reply, r <> 'none' AS escalate, r AS escalation_reason "
            f"FROM (SELECT event_id, {keyword()} AS intent, {keyword_reason()} AS r {EVENTS})",
        "l5_judge": with_(
            judged(),
            "SELECT pair_id, round(overlap_score, 3) AS overlap_score, grounded_score, length_ok, unsupported_claims FROM judged",
        ),
        "l6_golden_set": with_(
            PAIRS,
            "SELECT pair_id, conversation_id, intent_label, escalation_reason <> 'none' AS should_escalate, "
            "escalation_reason, 'rule_based_v1' AS label_method FROM gold",
        ),
        "l7_l8_three_systems": with_(
            PREDICTIONS,
            "SELECT system, n, round(accuracy, 6) AS intent_accuracy, round(macro_f1, 6) AS intent_macro_f1, "
            f"round(weighted_f1, 6) AS intent_weighted_f1, {escalation_columns(6)} FROM sys",
        ),
        "l9_label_diagnosis":
            "SELECT count(*) AS n, CAST(count_if(many) AS BIGINT) AS multi_match, avg(CASE WHEN many THEN 1.0 ELSE 0.0 END) AS share, "
            f"count(*) - count(DISTINCT k) AS duplicates FROM (SELECT {strip('lower(customer_msg)')} AS k, "
            + " + ".join(f"CAST({hit('customer_msg', p)} AS INT)" for _n, p in R.INTENT_RULES)
            + f" > 1 AS many {EVENTS})",
        "l9_other_bucket": with_(
            PAIRS + f", o AS (SELECT customer_msg FROM kept WHERE {intent()} = 'other')",
            word_profile("o", "customer_msg"),
        ),
        "s1_score_stream": with_(
            retrieval("sp") + "," + decisions("sp"),
            "SELECT event_id, intent, draft_reply, grounded, escalate, reason_out AS escalation_reason FROM dec",
        ),
    }
    near = replace("lower({})", rf"[^\p{{L}}\p{{N}}{X.SPACE}]")
    leaks = []
    for kind in ("exact", "near"):
        for pool, table in (("dev", "dev"), ("retrieval", "ret")):
            a = "ev.customer_msg" if kind == "exact" else near.replace("{}", "ev.customer_msg")
            b = "customer_msg" if kind == "exact" else near.replace("{}", "customer_msg")
            leaks.append(
                f"SELECT '{kind}' AS kind, '{pool}' AS other_pool, pair_id FROM ev WHERE {a} IN (SELECT {b} FROM {table})"
            )
    sql["e8_text_leakage"] = with_(PAIRS, " UNION ALL ".join(leaks))
    diversity = f"""
picked AS (SELECT company, conversation_id, conversation FROM tr
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY md5('42:' || conversation_id), conversation_id) <= 2000),
ws AS (SELECT company, unnest([w for w in string_split_regex(lower(conversation), {q(X.SPACES_PATTERN)}) if w <> '']) AS word FROM picked),
div AS (SELECT company AS brand, round(count(DISTINCT word) / greatest(count(*), 1), 4) AS vocab_diversity FROM ws GROUP BY company)"""
    sql["f2_vocab_diversity"] = with_(f"{TRANSCRIPTS},{diversity}", "SELECT brand, vocab_diversity FROM div")
    volume = sql["f1_brand_profile"].split("tpairs AS", 1)[1]
    volume = volume[volume.index("SELECT company AS brand"):]
    sql["h1_brands_by_volume"] = with_(
        f"{TRANSCRIPTS},{diversity}, vol AS ({volume})",
        f"SELECT vol.*, vocab_diversity FROM vol JOIN div USING (brand) WHERE brand IN {BRANDS}",
    )
    return sql


def word_profile(src: str, text: str) -> str:
    return (
        "SELECT count(*) AS n, min(w) AS min_words, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS median, "
        "quantile_cont(w, 0.75) AS p75, max(w) AS max_words, CAST(count_if(w <= 5) AS BIGINT) AS short, "
        "count_if(w <= 5) / greatest(count(*), 1) AS short_share "
        f"FROM (SELECT CAST({words(text)} AS INTEGER) AS w FROM {src})"
    )


def judged() -> str:
    return f"""{retrieval('ev')},{decisions('ev')},
judged AS (SELECT pair_id, overlap_score, CAST(CASE WHEN overlap_score > 0.25 THEN 1 ELSE 0 END AS BIGINT) AS grounded_score,
    present AND {words('reply')} BETWEEN 10 AND 80 AS length_ok,
    CASE WHEN present THEN {claims('reply', 'replies')} ELSE '' END AS unsupported_claims
  FROM (SELECT *, CASE WHEN present THEN {overlap('reply', 'replies')} ELSE 0.0 END AS overlap_score
    FROM (SELECT pair_id, replies, coalesce(draft_reply, '') AS reply, coalesce(draft_reply, '') <> '' AS present FROM dec)))"""
