"""SQL for the same results as the queries, written for DuckDB over the test tables."""

from __future__ import annotations

from ..functions.fixed_values import CONTRACTIONS, LEMMA_EXCEPTIONS, METRIC_HEADERS
from .inputs import CLASS_PLACES, LINE_ID, SEED, STOP_WORDS, SYNONYM_PAIRS

WORD = r"[\pL\pN_]"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"
NOT_SPACE = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"
NOT_WORD_NOT_SPACE = r"[^\pL\pN_\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"

TEST_SHARE, VALIDATION_SHARE = 0.1, 0.19 / 0.9


# --- expression builders ----------------------------------------------------------------------


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def mapping(table: dict) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def word_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def replace(col: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({col}, {quoted(pattern)}, {quoted(by)}, 'g')"


def collapse(col: str) -> str:
    return f"trim({replace(col, SPACE + '+', ' ')})"


def soft(col: str) -> str:
    no_links = replace(replace(col, "@" + WORD + "+"), f"http{NOT_SPACE}+|www\\.{NOT_SPACE}+")
    return collapse(replace(f"replace({no_links}, '#', '')", "<.*?>"))


def words(col: str) -> str:
    return f"regexp_extract_all({col}, {quoted(NOT_SPACE + '+')})"


def squeeze(col: str) -> str:
    chars = f"string_split({col}, '')"
    rows = f"list_zip({chars}, list_concat([NULL], {chars}), list_concat([NULL, NULL], {chars}))"
    keep = "z[1] IS NOT NULL AND NOT coalesce(z[1] <> chr(10) AND z[1] = z[2] AND z[1] = z[3], false)"
    return f"array_to_string(list_transform(list_filter({rows}, lambda z: {keep}), lambda z: z[1]), '')"


def expand(col: str) -> str:
    shape = r"(?s)^([^\pL\pN']*)(.*?)([^\pL\pN]*)$"
    pieces = f"regexp_extract_all(replace({col}, '’', ''''), {quoted(f'{SPACE}+|{NOT_SPACE}+')})"

    def part(i: int, default: str) -> str:
        return f"CASE WHEN contains(p, '''') THEN regexp_extract(p, {quoted(shape)}, {i}) ELSE {default} END"

    core = part(2, "p")
    long = f"({mapping(CONTRACTIONS)})[lower({core})]"
    cased = f"CASE WHEN regexp_matches({core}, '^[A-Z]') THEN upper(substr({long}, 1, 1)) || substr({long}, 2) ELSE {long} END"
    new = f"CASE WHEN {long} IS NULL THEN p ELSE ({part(1, quoted(''))}) || ({cased}) || ({part(3, quoted(''))}) END"
    return f"array_to_string(list_transform({pieces}, lambda p: {new}), '')"


def stem(w: str) -> str:
    return (
        f"CASE WHEN regexp_matches({w}, '(bb|dd|gg|mm|nn|pp|rr|tt)$') THEN substr({w}, 1, len({w}) - 1) "
        f"WHEN regexp_matches({w}, '(at|iz|bl|v|c|u)$') THEN {w} || 'e' ELSE {w} END"
    )


def lemma(w: str) -> str:
    return f"coalesce(({mapping(LEMMA_EXCEPTIONS)})[{w}], {plain_lemma(w)})"


def plain_lemma(w: str) -> str:
    def cut(n: int) -> str:
        return f"substr({w}, 1, len({w}) - {n})"

    return (
        f"CASE "
        f"WHEN len({w}) > 4 AND {w} LIKE '%ies' THEN {cut(3)} || 'y' "
        f"WHEN len({w}) > 4 AND regexp_matches({w}, '(ss|sh|ch|x|z)es$') THEN {cut(2)} "
        f"WHEN len({w}) > 3 AND {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN {cut(1)} "
        f"WHEN len({w}) > 5 AND regexp_matches({w}, '[aeiouy].*ing$') THEN {stem(cut(3))} "
        f"WHEN len({w}) > 4 AND regexp_matches({w}, '[aeiouy].*ed$') THEN {stem(cut(2))} "
        f"ELSE {w} END"
    )


def lemmas(col: str) -> str:
    return f"array_to_string(list_transform({words(col)}, lambda w: {lemma('w')}), ' ')"


def content(col: str) -> str:
    kept = f"list_filter({words(col)}, lambda w: NOT list_contains({word_list(STOP_WORDS)}, lower(w)))"
    return f"array_to_string({kept}, ' ')"


def uniform(*parts: str) -> str:
    key = f"concat_ws(':', '{SEED}', {', '.join(parts)})"
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def shuffle_key(*parts: str) -> str:
    return f"md5(concat_ws(':', '{SEED}', {', '.join(parts)}))"


def staged_full(source: str, key: str, out: str, step: str = "s") -> str:
    """Full cleaning in steps, so that no expression is repeated inside another."""
    return f"""
        {step}1 AS MATERIALIZED (SELECT {key}, {soft('txt')} AS txt FROM ({source})),
        {step}2 AS MATERIALIZED (SELECT {key}, {expand('txt')} AS txt FROM {step}1),
        {step}3 AS MATERIALIZED (SELECT {key}, {squeeze('txt')} AS txt FROM {step}2),
        {step}4 AS MATERIALIZED (SELECT {key}, {replace('lower(txt)', NOT_WORD_NOT_SPACE)} AS txt FROM {step}3),
        {step}5 AS MATERIALIZED (SELECT {key}, {lemmas('txt')} AS txt FROM {step}4),
        {out} AS MATERIALIZED (SELECT {key}, {collapse(content('txt'))} AS full_text FROM {step}5)"""


WITH_LABELS = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


# --- duplicates -------------------------------------------------------------------------------


def groups(source: str, columns: list[str], label: str, key: str = "doc_id") -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS text_column, {c} AS txt, {label} AS label, {key} AS row_id FROM ({source})" for c in columns
    )
    return f"""SELECT *, n_text > 1 AND n_label_min = 1 AS conflicted FROM (
        SELECT *, sum(n) OVER same AS n_text, min(n) OVER same AS n_label_min, max(n) OVER same AS n_label_max
        FROM (SELECT text_column, txt, label, count(*) AS n, min(row_id) AS first_id FROM ({long}) GROUP BY ALL)
        WINDOW same AS (PARTITION BY text_column, txt))"""


def kept_ids(source: str, columns: list[str], label: str, key: str = "doc_id") -> str:
    return f"""SELECT first_id FROM ({groups(source, columns, label, key)}) WHERE NOT conflicted
        GROUP BY first_id HAVING count(*) = {len(columns)}"""


SOFT_DOCS = f"SELECT doc_id, text, source, {soft('text')} AS soft FROM documents"


# --- splits -----------------------------------------------------------------------------------


def quotas(source: str, stratum: str, shares: list[float]) -> str:
    sql = f"SELECT {stratum} AS stratum, count(*) AS rows, count(*) AS remaining FROM ({source}) GROUP BY 1"
    for i, share in enumerate(shares):
        sql = f"""SELECT * EXCLUDE (kept, total, flo, rest, missing, remaining),
            flo + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum NULLS LAST) <= missing THEN 1 ELSE 0 END AS remaining,
            (rows - (flo + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum NULLS LAST) <= missing THEN 1 ELSE 0 END))::BIGINT AS upto_{i}
            FROM (SELECT *, kept - sum(flo) OVER () AS missing FROM (
                SELECT *, (remaining * kept) // total AS flo, (remaining * kept) % total AS rest FROM (
                    SELECT *, sum(remaining) OVER () AS total,
                        (sum(remaining) OVER () - ceil({double(share)} * (sum(remaining) OVER ())::DOUBLE))::HUGEINT AS kept
                    FROM ({sql}))))"""
    return f"SELECT * EXCLUDE (remaining) FROM ({sql})"


def split(source: str, ids: list[str], stratum: str | None, shares: list[float], names: list[str]) -> str:
    key = stratum or "'all'"
    cases = " ".join(f"WHEN rn <= upto_{i} THEN '{names[i]}'" for i in range(len(shares)))
    return f"""SELECT r.* EXCLUDE (rn, strat), CASE {cases} ELSE '{names[-1]}' END AS split FROM (
            SELECT *, {key} AS strat, row_number() OVER (PARTITION BY {key} ORDER BY {shuffle_key(*ids)}) AS rn
            FROM ({source})) r
        JOIN ({quotas(source, key, shares)}) q ON r.strat IS NOT DISTINCT FROM q.stratum"""


def epoch_steps(source: str, epochs: int, buckets: int, rate: float) -> str:
    """CTEs up to ``p1``, ``p2``, … (doc_id, label, split, p): scores by the weights after each epoch of logistic regression."""
    bucket = f"(('0x' || substr(md5(w), 1, 8))::UBIGINT % {buckets})::INT"
    out = f"""lab AS MATERIALIZED ({source}),
        feat AS MATERIALIZED (SELECT doc_id, b, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS v FROM (
            SELECT doc_id, {bucket} AS b, count(*) AS n FROM (SELECT doc_id, unnest({words('lower(text)')}) AS w FROM lab) GROUP BY ALL)),
        w0 AS MATERIALIZED (SELECT unnest(range(-1, {buckets})) AS b, 0.0::DOUBLE AS w)"""
    for e in range(epochs + 1):
        out += f""",
        p{e} AS MATERIALIZED (SELECT doc_id, label, split, 1 / (1 + exp(-(coalesce(m, 0) + (SELECT w FROM w{e} WHERE b = -1)))) AS p
            FROM lab LEFT JOIN (SELECT doc_id, sum(v * w) AS m FROM feat JOIN w{e} USING (b) GROUP BY doc_id) USING (doc_id)),
        w{e + 1} AS MATERIALIZED (SELECT b, w - {rate}::DOUBLE * coalesce(g, 0) / (SELECT count(*) FROM lab WHERE split = 'train') AS w
            FROM w{e} LEFT JOIN (SELECT b, sum(v * (p - label)) AS g FROM p{e} JOIN feat USING (doc_id) WHERE split = 'train' GROUP BY b
                UNION ALL SELECT -1, sum(p - label) FROM p{e} WHERE split = 'train') USING (b))"""
    rows = " UNION ALL ".join(f"""SELECT {e} AS epoch, count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
            count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) AS n, count(*) FILTER (label = (p >= 0.5)::INT) AS hits
            FROM p{e} WHERE split = 'val'""" for e in range(1, epochs + 1))
    return out + f""",
        per_epoch AS (SELECT epoch::INT AS epoch, hits::DOUBLE / n AS accuracy, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
            CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM ({rows}))"""


def three_way(source: str, ids: list[str], stratum: str) -> str:
    return split(source, ids, stratum, [TEST_SHARE, VALIDATION_SHARE], ["test", "val", "train"])


# --- augmentation -----------------------------------------------------------------------------

SYNONYMS = f"""SELECT word, list_sort(list(DISTINCT synonym)) AS synonyms FROM (
    SELECT word, lower(translate(synonym, '_-', '  ')) AS synonym
    FROM (VALUES {', '.join(f'({quoted(w)}, {quoted(s)})' for w, s in SYNONYM_PAIRS)}) v(word, synonym))
    WHERE synonym <> word GROUP BY word"""


def pick(u: str) -> str:
    return f"synonyms[(floor({u} * len(synonyms)) + 1)::INT]"


def augmentation(source: str) -> str:
    """CTEs from ``source`` (doc_id, text) up to ``variants`` (doc_id, variant, method, text)."""
    limit = "greatest(1, floor(0.1::DOUBLE * len(ws))::INT)"
    return f"""
        base AS (SELECT doc_id, text, {words('text')} AS ws FROM ({source})),
        long AS (SELECT doc_id, ws, len(ws) AS size, {limit} AS many FROM base WHERE len(ws) >= 4),
        occ AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, size, many FROM long),
        syn AS ({SYNONYMS}),
        hits AS (SELECT doc_id, pos, word, many,
            CASE WHEN NOT list_contains({word_list(STOP_WORDS)}, word) THEN {uniform('doc_id', "'replace'", 'pos')} END AS u,
            {pick(uniform('doc_id', "'replacement'", 'pos'))} AS replacement,
            {pick(uniform('doc_id', "'insertion'", 'pos'))} AS insertion
            FROM occ JOIN syn USING (word)),
        limits AS (SELECT doc_id, list_sort(list(u))[least(any_value(many), count(u))] AS cap
            FROM hits WHERE u IS NOT NULL GROUP BY doc_id),
        chosen AS (SELECT h.doc_id, h.word, arg_min(h.replacement, h.u) AS replacement
            FROM hits h JOIN limits USING (doc_id) WHERE h.u IS NOT NULL
            GROUP BY h.doc_id, h.word, limits.cap HAVING min(h.u) <= limits.cap),
        sr AS (SELECT o.doc_id, string_agg(coalesce(c.replacement, o.word), ' ' ORDER BY o.pos) AS text
            FROM occ o LEFT JOIN chosen c USING (doc_id, word) GROUP BY o.doc_id),
        trials AS (SELECT doc_id, size, i, unnest(range(1, 11)) AS j
            FROM (SELECT doc_id, size, unnest(range(1, many + 1)) AS i FROM long)),
        picked AS (SELECT t.doc_id, t.i, t.size, arg_min(h.insertion, t.j) AS word
            FROM (SELECT *, floor({uniform('doc_id', "'try'", 'i', 'j')} * size)::BIGINT AS pos FROM trials) t
            JOIN hits h USING (doc_id, pos) GROUP BY ALL),
        inserted AS (SELECT doc_id, (floor({uniform('doc_id', "'place'", 'i')} * (size + 1)) * 2)::BIGINT AS pos, i AS rank, word FROM picked
            UNION ALL SELECT doc_id, pos * 2 + 1, 0, word FROM occ),
        ri AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos, rank) AS text FROM inserted GROUP BY doc_id),
        {swapping('long')},
        {deleting('long')},
        variants AS (
            SELECT doc_id, 1 AS variant, 'synonym' AS method, text FROM sr
            UNION ALL SELECT doc_id, 2, 'insert', text FROM ri
            UNION ALL SELECT doc_id, 3, 'swap', swapped FROM rs
            UNION ALL SELECT doc_id, 4, 'delete', shortened FROM rd
            UNION ALL SELECT doc_id, 1, 'copy', text FROM base WHERE len(ws) < 4)"""


def swapping(source: str, alpha: float = 0.1, rounds: int = 1) -> str:
    """CTEs up to ``rs``: each round swaps up to half of the words with the others, until the wanted swaps are done."""
    wanted = f"greatest(1, floor({alpha}::DOUBLE * size)::INT)"
    parts = [f"""
        swap_in0 AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS size FROM {source})"""]
    for k in range(rounds):
        tag = "swap" if k == 0 else f"swap{k}"
        parts.append(f"""
        swap_ranked{k} AS (SELECT doc_id, pos, word, size, 2 * greatest(0, least({wanted} - {k} * (size // 2), size // 2)) AS moved,
            row_number() OVER (PARTITION BY doc_id ORDER BY {uniform('doc_id', f"'{tag}'", 'pos')}, pos) AS k FROM swap_in{k}),
        swap_in{k + 1} AS (SELECT a.doc_id, b.word, a.pos, a.size FROM swap_ranked{k} a JOIN swap_ranked{k} b ON a.doc_id = b.doc_id
                AND b.k = CASE WHEN a.k > a.moved THEN a.k WHEN a.k % 2 = 1 THEN a.k + 1 ELSE a.k - 1 END)""")
    parts.append(f"""
        rs AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS swapped FROM swap_in{rounds} GROUP BY doc_id)""")
    return ",".join(parts)


def deleting(source: str) -> str:
    return f"""
        rd AS (SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (size = 1 OR
            {uniform('doc_id', "'delete'", 'pos')} > 0.1::DOUBLE), '') AS shortened
            FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS size FROM {source})
            GROUP BY doc_id)"""


WORDED = f"worded AS (SELECT doc_id, {words('text')} AS ws FROM documents)"


def majority_size(source: str, label: str) -> str:
    return f"(SELECT max(n) FROM (SELECT count(*) AS n FROM ({source}) WHERE {label} IS NOT NULL GROUP BY {label}))"


def balanced(source: str, label: str, only: str = "true", majority: str | None = None) -> str:
    majority = majority or majority_size(source, label)
    return f"""WITH src AS (SELECT doc_id, text, {label} AS label FROM ({source}) WHERE {only}),
        {augmentation('SELECT doc_id, text FROM src')},
        wanted AS (SELECT label, greatest(1, {majority} - count(*)) AS wanted FROM src GROUP BY label)
        SELECT doc_id, label AS {label}, text, variant, method, ordinal FROM (
            SELECT v.*, s.label, row_number() OVER (PARTITION BY s.label ORDER BY doc_id, variant) AS ordinal
            FROM variants v JOIN src s USING (doc_id))
        JOIN wanted USING (label) WHERE ordinal <= wanted"""


def vectors(source: str, weights: str, dims: int) -> str:
    """CTEs up to ``unit`` (id, b, x): non-zero values of the unit vectors of ``source`` (id, text), weighted by ``weights``."""
    bucket = f"(('0x' || substr(md5(w), 1, 8))::UBIGINT % {dims})::INT"

    def counts(rows: str) -> str:
        return f"SELECT id, {bucket} AS b, count(*) AS n FROM (SELECT id, unnest({words('lower(text)')}) AS w FROM ({rows})) GROUP BY ALL"

    return f"""
        idf AS (SELECT b, ln(((SELECT count(*) FROM ({weights})) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM ({counts(weights)}) GROUP BY b),
        weighted AS (SELECT id, b, n * coalesce(idf, ln(((SELECT count(*) FROM ({weights})) + 1)::DOUBLE)) AS x
            FROM ({counts(source)}) LEFT JOIN idf USING (b)),
        unit AS (SELECT id, b, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x FROM weighted)"""


def accepted(made: str, originals: str, label: str) -> str:
    """CTEs up to ``accepted``: rows of ``made`` that reach 0.85 against a candidate of their class in ``originals``."""
    return f"""made AS ({made}),
    fresh AS (SELECT *, doc_id || ':' || variant AS id FROM made
        WHERE ({label}, text) NOT IN (SELECT ({label}, text) FROM {originals} WHERE {label} IS NOT NULL)),
    sizes AS (SELECT {label}, count(*) AS n FROM fresh GROUP BY {label}),
    candidates AS (SELECT 'o' || doc_id AS id, text, {label} FROM (
        SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY doc_id) AS k FROM {originals}) JOIN sizes USING ({label}) WHERE k <= n),
    {vectors("SELECT id, text FROM fresh UNION ALL SELECT id, text FROM candidates",
             f"SELECT doc_id AS id, text FROM {originals}", 512)},
    scores AS (SELECT f.id, max(score) AS score FROM (
        SELECT f.id, c.id AS other, sum(a.x * b.x) AS score FROM fresh f JOIN candidates c USING ({label})
        JOIN unit a ON a.id = f.id JOIN unit b ON b.id = c.id AND a.b = b.b GROUP BY ALL) f GROUP BY f.id),
    accepted AS (SELECT fresh.* FROM fresh JOIN scores USING (id) WHERE round(score, 12) >= 0.85)"""


ACCEPTED = f"""WITH {accepted(balanced(f"SELECT * FROM {LABELLED}", "toxic", "toxic = 1"), LABELLED, "toxic")}
    SELECT doc_id, variant, method, TRUE AS near FROM accepted"""


def training_table(source: str, label: str, only: str = "true") -> str:
    """The balanced training table of a part: originals as prepared, then the accepted texts, numbered after them."""
    versions = ["tweet_text", "tweet_soft", "tweet_full"]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*versions, "label"])
    made = balanced("SELECT * FROM originals", "label", only, majority_size(f"SELECT * FROM {source}", label))
    return f"""WITH {staged_full(f"SELECT doc_id, text AS txt FROM {source}", "doc_id", "cleaned")},
    versions AS MATERIALIZED (SELECT doc_id, nullif(text, '') AS tweet_text, nullif({soft('text')}, '') AS tweet_soft,
        nullif(full_text, '') AS tweet_full, {label} AS label, source FROM {source} JOIN cleaned USING (doc_id)),
    originals AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, tweet_text AS text, tweet_soft, tweet_full, label, source
        FROM versions WHERE doc_id IN ({kept_ids('SELECT * FROM versions', versions, 'label')}) AND {whole}),
    {accepted(made, "originals", "label")},
    added AS MATERIALIZED (SELECT (SELECT max(doc_id) FROM originals) + row_number() OVER (ORDER BY doc_id, variant) AS sample_id, label, text
        FROM accepted),
    {staged_full("SELECT sample_id, text AS txt FROM added", "sample_id", "added_full", "z")},
    names AS (SELECT label, arg_max(source, doc_id) AS source FROM originals GROUP BY label)
    SELECT doc_id AS sample_id, label, source, FALSE AS is_augmented, text AS tweet_text, tweet_soft, tweet_full FROM originals
    UNION ALL SELECT sample_id, label, source, TRUE, text, {soft('text')}, full_text
    FROM added JOIN added_full USING (sample_id) JOIN names USING (label)"""


# --- evaluation -------------------------------------------------------------------------------

SCORED = f"""SELECT {', '.join(LINE_ID)}, (l_returnflag = 'R')::INT AS true_label,
    round({uniform('l_orderkey', "'score'", 'l_linenumber')} * 0.7::DOUBLE + (l_returnflag = 'R')::INT * 0.3::DOUBLE, 3) AS probability
    FROM lineitem"""


def score_groups(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
        sum(pos) OVER ({part}) AS all_pos, sum(neg) OVER ({part}) AS all_neg
        FROM (SELECT {lead}probability AS score, count(*) FILTER (true_label = 1) AS pos,
            count(*) FILTER (true_label <> 1) AS neg FROM ({source}) GROUP BY {lead}probability)"""


AREAS = {
    "roc_auc": "round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(all_pos)::DOUBLE * any_value(all_neg)::DOUBLE), 6)",
    "pr_auc": "round(sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(all_pos), 6)",
    "pr_trapezoid": """round(sum(pos * (tp::DOUBLE / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0
        ELSE (tp - pos)::DOUBLE / (tp - pos + fp - neg) END) / 2) / any_value(all_pos), 6)""",
}


def areas(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"SELECT {lead}{', '.join(f'{e} AS {n}' for n, e in AREAS.items())} FROM ({score_groups(source, by)}) {tail}"


def metric_row(source: str, threshold: str) -> str:
    return f"""SELECT {threshold} AS threshold, tn, fp, fn, tp,
        (tp + tn)::DOUBLE / n AS accuracy,
        (rec + spec) / 2 AS balanced_accuracy,
        f_pos AS f1, prec AS precision, rec AS recall, spec AS specificity, npv,
        (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
        ((tp + tn)::DOUBLE / n - chance) / (1 - chance) AS kappa,
        (f_pos + f_neg) / 2 AS f1_macro,
        share * f_pos + (1 - share) * f_neg AS f1_weighted,
        (prec + npv) / 2 AS precision_macro, share * prec + (1 - share) * npv AS precision_weighted,
        (rec + spec) / 2 AS recall_macro, share * rec + (1 - share) * spec AS recall_weighted,
        roc_auc, pr_auc, pr_trapezoid
        FROM (SELECT *, tp + tn + fp + fn AS n, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / (tp + fn) AS rec,
            tn::DOUBLE / (tn + fp) AS spec, tn::DOUBLE / (tn + fn) AS npv,
            2.0 * tp / (2 * tp + fp + fn) AS f_pos, 2.0 * tn / (2 * tn + fp + fn) AS f_neg,
            (tp + fn)::DOUBLE / (tp + tn + fp + fn) AS share,
            ((tp + fn)::DOUBLE * (tp + fp) + (tn + fp)::DOUBLE * (tn + fn)) / ((tp + tn + fp + fn)::DOUBLE * (tp + tn + fp + fn)) AS chance
            FROM (SELECT count(*) FILTER (true_label = 0 AND probability < {threshold}) AS tn,
                count(*) FILTER (true_label = 0 AND probability >= {threshold}) AS fp,
                count(*) FILTER (true_label = 1 AND probability < {threshold}) AS fn,
                count(*) FILTER (true_label = 1 AND probability >= {threshold}) AS tp FROM ({source})),
            ({areas(source)}))"""


METRICS = (
    "accuracy balanced_accuracy f1 precision recall specificity npv mcc kappa f1_macro f1_weighted "
    "precision_macro precision_weighted recall_macro recall_weighted roc_auc pr_auc pr_trapezoid"
).split()

YOUDEN = """SELECT coalesce(arg_max(score, (gain, score)) FILTER (gain > 0), 'inf'::DOUBLE) AS threshold,
    greatest(0, max(gain))::DOUBLE / (any_value(all_pos)::DOUBLE * any_value(all_neg)) AS youden_j
    FROM (SELECT *, tp::HUGEINT * all_neg - fp::HUGEINT * all_pos AS gain FROM ({groups}))"""

LOGITS = f"""SELECT vec_id, label AS true_label, [{', '.join(
    f"({' + '.join(f'embedding[{i + 1}]::DOUBLE' for i in places)}) * 4 + CASE WHEN label = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    for k, places in enumerate(CLASS_PLACES))}] AS logits FROM embeddings"""
SOFTMAX = f"""SELECT vec_id, true_label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
    SELECT vec_id, true_label, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM ({LOGITS}))"""
CLASS_SCORES = f"""SELECT vec_id, true_label, q, list_position(q, list_max(q)) - 1 AS pred_label
    FROM (SELECT vec_id, true_label, list_transform(p, lambda x: round(x, 9)) AS q FROM ({SOFTMAX}))"""
OVR = f"""SELECT class, (label = class)::INT AS true_label, probability FROM (
    SELECT true_label AS label, unnest(range(10)) AS class, unnest(q) AS probability FROM ({CLASS_SCORES}))"""

BLENDED = """SELECT vec_id, label, list_transform(list_zip(embedding, list_reverse(embedding)),
    lambda z: z[1]::DOUBLE + z[2]::DOUBLE) AS v FROM embeddings"""


def best_match(by_label: bool) -> str:
    where = "WHERE s.label = t.label" if by_label else ""
    return f"""SELECT vec_id, round(score, 6) AS similarity_score, match_id, match_label FROM (
        SELECT s.vec_id, t.vec_id AS match_id, t.label AS match_label,
            list_cosine_similarity(s.v, t.embedding::DOUBLE[]) AS score,
            row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_cosine_similarity(s.v, t.embedding::DOUBLE[]), 12) DESC, t.vec_id) AS k
        FROM ({BLENDED}) s, embeddings t {where}) WHERE k = 1"""


# --- language ---------------------------------------------------------------------------------


def grams(source: str, key: str) -> str:
    return f"""SELECT {key}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2])) AS gram
        FROM (SELECT {key}, string_split(lower({collapse('text')}), '') AS c FROM ({source}))"""


def identified(train: str, source: str, key: str) -> str:
    """CTEs up to ``found`` (key, language)."""
    return f"""
        train AS ({train}),
        seen AS (SELECT lang, gram, count(*) AS n FROM ({grams('SELECT * FROM train', 'lang')}) GROUP BY ALL),
        kept AS (SELECT gram FROM seen GROUP BY gram HAVING sum(n) >= 1),
        langs AS (SELECT lang, ln(count(*)::DOUBLE / (SELECT count(*) FROM train)) AS prior FROM train GROUP BY lang),
        totals AS (SELECT lang, sum(n) AS total FROM seen JOIN kept USING (gram) GROUP BY lang),
        logs AS (SELECT k.gram, l.lang, ln((coalesce(s.n, 0) + 1)::DOUBLE / (t.total + (SELECT count(*) FROM kept))) AS lp
            FROM kept k CROSS JOIN langs l JOIN totals t USING (lang) LEFT JOIN seen s ON s.gram = k.gram AND s.lang = l.lang),
        counted AS (SELECT {key}, gram, count(*) AS n FROM ({grams(source, key)}) GROUP BY ALL),
        scores AS (SELECT {key}, lang, sum(n * lp) + any_value(prior) AS score FROM counted JOIN logs USING (gram) JOIN langs USING (lang) GROUP BY ALL),
        found AS (SELECT {key}, lang AS language FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang) AS k FROM scores) WHERE k = 1)"""


def vocabulary(size: int) -> str:
    return f"""SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 1)::INT AS word_id FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest({words('lower(text)')}) AS word FROM conversations)
        GROUP BY word ORDER BY n DESC, word LIMIT {size})"""


TURNS = "SELECT conv_id * 1000 + turn AS turn_id, role, text FROM conversations"
HISTOGRAM = """SELECT b::INT AS bin, round(lo + b * w, {digits}) AS bin_start, round(lo + (b + 1) * w, {digits}) AS bin_end,
    coalesce(n, 0) AS n
    FROM (SELECT unnest(range(30)) AS b) g
    CROSS JOIN (SELECT min(x)::DOUBLE AS lo, (max(x)::DOUBLE - min(x)::DOUBLE) / 30 AS w FROM ({source})) r
    LEFT JOIN (SELECT least(floor((x::DOUBLE - lo) / w), 29) AS hb, count(*) AS n FROM ({source}),
        (SELECT min(x)::DOUBLE AS lo, (max(x)::DOUBLE - min(x)::DOUBLE) / 30 AS w FROM ({source})) GROUP BY 1) h ON h.hb = g.b"""


def text_means(source: str) -> str:
    return f"""SELECT round(avg(length(text)), 6) AS mean_chars,
        round(avg(len({words('text')})), 6) AS mean_words,
        round(avg(len(regexp_extract_all(text, '#{WORD}+'))), 6) AS mean_hashtags,
        round(avg(len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]'))), 6) AS mean_emoji FROM {source}"""


def column_profile(source: str, columns: dict[str, bool]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, "
        + (f"count(*) FILTER (regexp_matches({c}, '^{SPACE}*$'))" if is_text else "0::BIGINT")
        + f" AS blank FROM {source}"
        for c, is_text in columns.items()
    )


PROFILED = {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False, "quality": False, "toxic": False}
DUPLICATES = "SELECT count(*) - count(DISTINCT text) - max((text IS NULL)::INT) AS duplicates FROM {source}"
SUMMARY = """SELECT coalesce(sum(n) FILTER (n_text > 1), 0)::BIGINT AS duplicate_rows,
    coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS perfect_rows,
    coalesce(sum(n) FILTER (n_text > 1 AND n_label_max = 1), 0)::BIGINT AS imperfect_rows FROM ({groups})"""


def overview() -> str:
    d = groups("SELECT * FROM documents", ["text"], "source")
    profile = column_profile(WITH_LABELS, {"doc_id": False, "text": True, "source": True, "toxic": False})
    means = ["mean_chars", "mean_words", "mean_hashtags", "mean_emoji"]
    sums = ["duplicate_rows", "perfect_rows", "imperfect_rows"]
    parts = [
        "SELECT 'class' AS metric, source AS key, count(*)::DOUBLE AS value FROM documents WHERE source IS NOT NULL GROUP BY source",
        "SELECT 'imbalance_ratio', '', max(n)::DOUBLE / min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
        f"SELECT 'missing', \"column\", missing FROM ({profile})",
        f"SELECT 'blank', \"column\", blank FROM ({profile})",
        *[f"SELECT '{m}', '', {m} FROM ({text_means('documents')})" for m in means],
        f"SELECT 'duplicates', '', duplicates FROM ({DUPLICATES.format(source='documents')})",
        *[f"SELECT '{m}', '', {m} FROM ({SUMMARY.format(groups=d)})" for m in sums],
        f"SELECT 'duplicate_label', label, sum(n) FROM ({d}) WHERE n_text > 1 AND label IS NOT NULL GROUP BY label",
        f"""SELECT 'binary_share', CASE toxic WHEN 0 THEN 'No' ELSE 'Yes' END, count(*)::DOUBLE / sum(count(*)) OVER ()
            FROM {WITH_LABELS} WHERE toxic IS NOT NULL GROUP BY toxic""",
    ]
    return f"SELECT metric, key, round(value::DOUBLE, 6) AS value FROM ({' UNION ALL '.join(parts)})"


def ordinal(column: str, source: str) -> str:
    return f"SELECT {column}, (row_number() OVER (ORDER BY {column} NULLS LAST) - 1)::INT AS code FROM (SELECT DISTINCT {column} FROM {source})"


BUILT = f"""SELECT d.doc_id, d.lang, {soft('text')} AS tweet_soft, full_text AS tweet_full,
    (d.lang IS DISTINCT FROM 'en')::INT AS is_cyberbullying, m.code AS cyberbullying_label
    FROM documents d JOIN cleaned USING (doc_id) JOIN ({ordinal('lang', 'documents')}) m USING (lang)"""
FULL_DOCS = "SELECT doc_id, text AS txt FROM documents"
RAW_KEPT = kept_ids("SELECT * FROM documents WHERE lang IS DISTINCT FROM 'de'", ["text"], "lang")

DIAGNOSED = ["tweet_text", "tweet_soft", "tweet_full"]


def best_scores(version: str) -> str:
    """CTEs up to ``best`` (x): the best score of each synthetic row against the originals of its class."""
    vectored = f"SELECT sample_id AS id, {version} AS text FROM versions WHERE {version} IS NOT NULL"
    return f"""{vectors(vectored, vectored + " AND NOT is_augmented", 128)},
        dense AS MATERIALIZED (SELECT sample_id, any_value(label) AS label, any_value(is_augmented) AS is_augmented,
            list(coalesce(x, 0) ORDER BY g.b) AS e
            FROM versions CROSS JOIN (SELECT unnest(range(128)) AS b) g LEFT JOIN unit ON unit.id = sample_id AND unit.b = g.b GROUP BY sample_id),
        best AS MATERIALIZED (SELECT s.sample_id, round(coalesce(max(list_dot_product(s.e, o.e)), 0), 12) AS x
            FROM dense s LEFT JOIN dense o ON s.label = o.label AND NOT o.is_augmented WHERE s.is_augmented GROUP BY s.sample_id)"""


DIAGNOSTICS = f"""WITH made AS ({balanced('SELECT * FROM documents', 'lang')}),
    every AS MATERIALIZED (SELECT doc_id AS sample_id, text AS txt, lang AS label, FALSE AS is_augmented FROM documents
        UNION ALL SELECT doc_id * 4 + variant + 1000000000, text, lang, TRUE FROM made),
    {staged_full("SELECT * FROM every", "sample_id", "cleaned")},
    versions AS MATERIALIZED (SELECT sample_id, label, is_augmented, txt AS tweet_text, {soft('txt')} AS tweet_soft, full_text AS tweet_full
        FROM every JOIN cleaned USING (sample_id))
    """ + " UNION ALL ".join(
    f"""SELECT '{v}' AS version, bin, n FROM (WITH {best_scores(v)} {HISTOGRAM.format(source='SELECT x FROM best WHERE x >= 0', digits=6)})"""
    for v in DIAGNOSED
)

ORACLE: dict[str, str] = {
    "soft_clean": f"SELECT doc_id, {soft('text')} AS soft FROM documents",
    "soft_clean_pages": f"SELECT page_id, {soft(chr(39).join(['concat_ws(', ' ', ', url, html)']))} AS soft FROM pages",
    "strip_tags": f"SELECT page_id, {replace('html', '<.*?>')} AS stripped FROM pages",
    "remove_parts": f"""SELECT doc_id, {replace('text', '@' + WORD + '+')} AS no_mentions,
        replace(text, '#', '') AS no_hash_sign,
        {replace('text', r'[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+')} AS no_emoji,
        {replace('text', r'[^\x00-\x7F]+')} AS ascii_only,
        {replace('text', NOT_WORD_NOT_SPACE)} AS no_punctuation, {collapse('text')} AS one_space FROM documents""",
    "tokens": f"""SELECT doc_id, len(ws)::INT AS n_tokens, array_to_string(ws, '|') AS tokens, length(text)::INT AS n_characters
        FROM (SELECT doc_id, text, {words('text')} AS ws FROM documents)""",
    "squeeze_repeats": f"SELECT doc_id, {squeeze('text')} AS squeezed FROM documents",
    "expand_contractions": f"""SELECT doc_id, {expand('t')} AS expanded FROM (
        SELECT doc_id, replace(replace(text, 'of', 'don''t'), 'is ', 'You''re gonna ') AS t FROM documents)""",
    "lemmatise": f"SELECT doc_id, {lemmas('lower(text)')} AS lemmas FROM documents",
    "remove_stop_words": f"SELECT doc_id, {content('text')} AS content FROM documents",
    "full_clean": f"WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')} SELECT * FROM cleaned",
    "preprocess_full": f"""WITH {staged_full(f"SELECT conv_id, turn, {soft('text')} AS txt FROM conversations", 'conv_id, turn', 'cleaned')}
        SELECT * FROM cleaned""",
    "preprocess_soft": f"SELECT conv_id, turn, {soft('text')} AS soft_text FROM conversations",
    "clean_by_dictionary": f"""WITH {staged_full("SELECT doc_id, text AS txt FROM documents", 'doc_id', 'unused')},
        dictionary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS word FROM documents),
        placed AS (SELECT doc_id, unnest({words('txt')}) AS word, unnest(range(len({words('txt')}))) AS place FROM s4),
        based AS (SELECT doc_id, place, CASE WHEN d.word IS NULL THEN {plain_lemma('p.word')} ELSE substr(p.word, 1, 5) END AS word
            FROM placed p LEFT JOIN dictionary d USING (word))
        SELECT doc_id, coalesce(full_text, '') AS full_text FROM documents LEFT JOIN (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS full_text FROM based
            WHERE NOT list_contains({word_list(STOP_WORDS)}, word) GROUP BY doc_id) USING (doc_id)""",
    "replace_tokens": f"""SELECT doc_id, array_to_string(list_transform(
        regexp_extract_all(text, {quoted(f'{SPACE}+|{NOT_SPACE}+')}),
        lambda p: CASE p WHEN 'the' THEN 'THE' WHEN 'que' THEN 'QUE' WHEN 'und' THEN '' ELSE p END), '') AS text FROM documents""",
    "null_as_text": f"SELECT doc_id, coalesce(toxic::VARCHAR, 'nan') AS toxic_text FROM {WITH_LABELS}",
    "drop_class": f"SELECT doc_id, coalesce(toxic, -1) AS toxic FROM {WITH_LABELS} WHERE toxic IS DISTINCT FROM 1",
    "drop_missing": f"SELECT doc_id, toxic, quality FROM {WITH_LABELS} WHERE toxic IS NOT NULL AND quality IS NOT NULL",
    "empty_to_null": f"""SELECT doc_id, CASE WHEN toxic = 0 THEN NULL ELSE toxic::VARCHAR END AS toxic_text,
        nullif(lang, 'de') AS lang FROM {WITH_LABELS}""",
    "keep_renamed": "SELECT doc_id AS row_id, text AS tweet_text, lang AS label FROM documents",
    "class_slice": f"SELECT doc_id, CASE WHEN toxic = 1 THEN 'inside' ELSE 'outside' END AS part FROM {WITH_LABELS}",
    "keep_flagged": f"SELECT doc_id, lang FROM {WITH_LABELS} WHERE quality = 1",
    "binary_label": "SELECT doc_id, (lang IS DISTINCT FROM 'en')::INT AS label FROM documents",
    "ordinal_labels": f"SELECT doc_id, lang, code AS label FROM documents JOIN ({ordinal('lang', 'documents')}) USING (lang)",
    "event_type_codes": f"SELECT event_id, event_type, code AS label FROM events JOIN ({ordinal('event_type', 'events')}) USING (event_type)",
    "label_map": ordinal("source", "documents"),
    "label_map_json": f"""SELECT '{{' || string_agg('"' || lang || '":' || code, ',' ORDER BY code) || '}}' AS value
        FROM ({ordinal('lang', 'documents')})""",
    "one_vs_rest": "SELECT vec_id, class::INT AS class, (label = class)::INT AS indicator FROM (SELECT vec_id, label, unnest(range(10)) AS class FROM embeddings)",
    "last_label_per_source": "SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source",
    "label_names": """SELECT d.doc_id, d.source, coalesce(m.lang, 'unknown') AS category FROM documents d LEFT JOIN (
        SELECT * FROM (SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source) WHERE lang <> 'en') m USING (source)""",
    "build_dataset": f"WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')} {BUILT}",
    "class_distribution": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
    "class_sizes": f"SELECT toxic, count(*) AS n FROM {WITH_LABELS} WHERE toxic IS NOT NULL GROUP BY toxic",
    "imbalance_ratio": "SELECT round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "binary_shares": f"""SELECT CASE toxic WHEN 0 THEN 'No' ELSE 'Yes' END AS label,
        round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM {WITH_LABELS} WHERE toxic IS NOT NULL GROUP BY toxic""",
    "missing_and_blank": column_profile(WITH_LABELS, PROFILED),
    "text_means": text_means("conversations"),
    "hashtag_emoji_means": text_means("documents"),
    "surplus_duplicates": DUPLICATES.format(source="documents"),
    "duplicate_summary": SUMMARY.format(groups=groups("SELECT * FROM documents", ["text"], "source")),
    "duplicate_labels": f"""SELECT label, sum(n)::BIGINT AS n FROM ({groups('SELECT * FROM documents', ['text'], 'source')})
        WHERE n_text > 1 AND label IS NOT NULL GROUP BY label""",
    "price_histogram": HISTOGRAM.format(source="SELECT l_extendedprice AS x FROM lineitem", digits=4),
    "before_after_counts": f"""SELECT source, count(*) AS before,
        count(*) FILTER (doc_id IN ({kept_ids('SELECT * FROM documents', ['text'], 'source')})) AS after FROM documents GROUP BY source""",
    "overview": overview(),
    "dedupe_conflicts": f"SELECT doc_id, source FROM documents WHERE doc_id IN ({kept_ids('SELECT * FROM documents', ['text'], 'source')})",
    "dedupe_multi": f"SELECT doc_id, source FROM documents WHERE doc_id IN ({kept_ids(SOFT_DOCS, ['text', 'soft'], 'source')})",
    "removal_report": f"""SELECT text_column, sum(CASE WHEN conflicted THEN n ELSE 0 END)::BIGINT AS conflict_rows,
        sum(CASE WHEN conflicted THEN 0 ELSE n - 1 END)::BIGINT AS repeat_rows
        FROM ({groups(SOFT_DOCS, ['text', 'soft'], 'source')}) GROUP BY text_column""",
    "dense_id": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id FROM orders",
    "running_quantity": f"""SELECT {', '.join(LINE_ID)}, l_returnflag, l_quantity,
        sum(l_quantity::DOUBLE) OVER w AS running_quantity, count(*) OVER w AS running_rows FROM lineitem
        WINDOW w AS (PARTITION BY l_returnflag ORDER BY {', '.join(LINE_ID)} ROWS UNBOUNDED PRECEDING)""",
    "first_of_class": """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k,
        floor(count(*) OVER (PARTITION BY lang) / 3) AS n FROM documents) WHERE k <= n""",
    "seeded_shuffle": f"SELECT doc_id, lang, {shuffle_key('doc_id')} AS shuffle_key FROM documents",
    "next_free_id": "SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents) AS new_id FROM documents",
    "stratified_split": f"SELECT doc_id, toxic, split FROM ({three_way(f'SELECT * FROM {LABELLED}', ['doc_id'], 'toxic')})",
    "stratified_split_lines": three_way(f"SELECT {', '.join(LINE_ID)}, l_returnflag FROM lineitem", LINE_ID, "l_returnflag"),
    "plain_split": split("SELECT o_orderkey FROM orders", ["o_orderkey"], None, [0.1], ["test", "train"]),
    "split_quotas": quotas("SELECT * FROM events", "event_type", [TEST_SHARE, VALIDATION_SHARE]),
    "texts_in_benchmark": """SELECT doc_id, length(text)::INT AS n_characters FROM (
        SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark) WHERE text IN (SELECT text FROM benchmark)""",
    "texts_not_in_documents": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)",
    "key_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "distinct_labels": "SELECT DISTINCT lang, source FROM documents",
    "stack_tables": """SELECT doc_id, lang, length(text)::INT AS n_characters FROM documents
        UNION ALL SELECT item_id, NULL, length(text)::INT FROM benchmark""",
    "align_versions": f"SELECT doc_id, coalesce(toxic, -1) AS toxic, {soft('text')} AS tweet_soft, lower(text) AS tweet_full FROM {WITH_LABELS}",
    "alignment_violations": f"""SELECT count(*) AS rows, count(*) FILTER (toxic IS NULL) AS nulls,
        count(*) > 0 AND count(*) FILTER (toxic IS NULL) = 0 AS valid FROM {WITH_LABELS}""",
    "nearest_label": best_match(False),
    "nearest_within_label": f"SELECT vec_id, similarity_score, match_id FROM ({best_match(True)})",
    "predict_class": f"""SELECT vec_id, 's' || vec_id AS tweet_text, match_label::VARCHAR AS predicted_class, similarity_score,
        't' || match_id AS most_similar_target_text FROM ({best_match(False)}) WHERE similarity_score >= 0.7""",
    "similarity_histogram": HISTOGRAM.format(source=f"SELECT similarity_score AS x FROM ({best_match(False)}) WHERE similarity_score >= 0", digits=6),
    "cosine": """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity,
        0.0::DOUBLE AS to_zero FROM embeddings""",
    "mean_word_vectors": f"""WITH w AS (SELECT item_id, unnest({words('text')}) AS word FROM benchmark),
        known AS (SELECT w.item_id, e.embedding FROM w JOIN embeddings e ON e.vec_id =
            ('0x' || substr(md5(w.word), 1, 8))::UBIGINT::BIGINT % (SELECT count(*) FROM embeddings)),
        part AS (SELECT item_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM known),
        mean AS (SELECT item_id, i, avg(x) AS m FROM part GROUP BY ALL)
        SELECT item_id, string_agg(coalesce(round(m * 1e6), 0)::INT::VARCHAR, ',' ORDER BY i) AS vector
        FROM benchmark CROSS JOIN (SELECT unnest(range(64)) AS i) g LEFT JOIN mean USING (item_id, i) GROUP BY item_id""",
    "aug_swap": f"WITH {WORDED}, {swapping('worded')} SELECT doc_id, swapped FROM rs",
    "text_vectors": f"""WITH {vectors("SELECT doc_id AS id, text FROM documents", "SELECT doc_id AS id, text FROM documents", 64)}
        SELECT doc_id, string_agg(coalesce(round(x * 1e6), 0)::INT::VARCHAR, ',' ORDER BY g.b) AS vector
        FROM documents CROSS JOIN (SELECT unnest(range(64)) AS b) g LEFT JOIN unit ON unit.id = doc_id AND unit.b = g.b GROUP BY doc_id""",
    "accept_similar": ACCEPTED,
    "balance_training_binary": f"SELECT * EXCLUDE (source) FROM ({training_table(LABELLED, 'toxic', 'label = 1')})",
    "balancing_diagnostics": DIAGNOSTICS,
    "balance_training_classes": training_table("documents", "lang"),
    "aug_swap_most": f"WITH {WORDED}, {swapping('worded', 0.8, 2)} SELECT doc_id, swapped FROM rs",
    "dense_id_text": """SELECT doc_id, (row_number() OVER (ORDER BY source, text, doc_id) + 99)::BIGINT AS sample_id FROM documents""",
    "partly_labelled_metrics": """SELECT count(*) FILTER (toxic = 0 AND score < 0.5) AS tn, count(*) FILTER (toxic = 0 AND score >= 0.5) AS fp,
        count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp
        FROM (SELECT toxic, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id))""",
    "aug_delete": f"WITH {WORDED}, {deleting('worded')} SELECT doc_id, shortened FROM rd",
    "aug_synonym": f"WITH {augmentation('SELECT doc_id, text FROM documents')} SELECT doc_id, text FROM variants WHERE method = 'synonym'",
    "aug_insert": f"WITH {augmentation('SELECT doc_id, text FROM documents')} SELECT doc_id, text FROM variants WHERE method = 'insert'",
    "augment_all": f"WITH {augmentation('SELECT doc_id, text FROM documents')} SELECT * FROM variants",
    "synonym_lists": f"""SELECT word, n, array_to_string(synonyms, '|') AS synonyms FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word) JOIN ({SYNONYMS}) USING (word)""",
    "balanced_table": f"""SELECT doc_id, toxic, text, FALSE AS is_augmented, 0 AS variant FROM {LABELLED} UNION ALL
        SELECT doc_id, toxic, text, TRUE, variant::INT FROM ({balanced(f"SELECT * FROM {LABELLED}", "toxic", "toxic = 1")})""",
    "balance_class": balanced(f"SELECT * FROM {LABELLED}", "toxic", "toxic = 1"),
    "balance_all": balanced("SELECT * FROM documents", "lang"),
    "new_texts": f"""WITH {augmentation('SELECT doc_id, text FROM documents')}
        SELECT v.doc_id, v.variant FROM variants v JOIN documents d USING (doc_id)
        WHERE (d.lang, v.text) NOT IN (SELECT (lang, text) FROM documents)""",
    "language_id": f"""WITH {identified('SELECT text, lang FROM documents', 'SELECT * FROM documents', 'doc_id')}
        SELECT doc_id, language FROM documents LEFT JOIN found USING (doc_id)""",
    "keep_language": f"""WITH {identified('SELECT text, lang FROM documents', TURNS, 'turn_id')}
        SELECT turn_id, role FROM ({TURNS}) JOIN found USING (turn_id) WHERE language = 'en'""",
    "language_accuracy": f"""WITH parts AS ({three_way('SELECT * FROM documents', ['doc_id'], 'lang')}),
        {identified("SELECT text, lang FROM parts WHERE split = 'train'", "SELECT * FROM parts WHERE split = 'test'", 'doc_id')}
        SELECT count(*) AS n, round(avg((language = lang)::INT), 6) AS accuracy FROM parts LEFT JOIN found USING (doc_id) WHERE split = 'test'""",
    "vocabulary": vocabulary(2000),
    "fixed_length_ids": f"""WITH vocab AS ({vocabulary(2000)}),
        w AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
            SELECT conv_id, turn, {words('lower(text)')}[1:128] AS ws FROM conversations)),
        ids AS (SELECT conv_id, turn, list(coalesce(word_id, 1) ORDER BY pos) AS ids FROM w LEFT JOIN vocab USING (word) GROUP BY ALL)
        SELECT conv_id, turn, array_to_string(list_concat(coalesce(ids, []), list_transform(range(128 - len(coalesce(ids, []))), lambda x: 0)), ' ') AS input_ids,
            repeat('1', len(coalesce(ids, []))) || repeat('0', 128 - len(coalesce(ids, []))) AS attention_mask
        FROM conversations LEFT JOIN ids USING (conv_id, turn)""",
    "softmax": f"SELECT vec_id, {', '.join(f'round(p[{i + 1}], 6) AS p{i}' for i in range(10))} FROM ({SOFTMAX})",
    "decide": f"SELECT vec_id, (list_position(logits, list_max(logits)) - 1)::INT AS pred_label FROM ({LOGITS})",
    "confusion": f"""SELECT t.c AS true_label, p.c AS pred_label, count(s.true_label) AS n
        FROM (VALUES (0), (1)) t(c) CROSS JOIN (VALUES (0), (1)) p(c)
        LEFT JOIN ({SCORED}) s ON s.true_label = t.c AND (s.probability >= 0.5)::INT = p.c GROUP BY ALL""",
    "binary_metrics": f"""SELECT threshold, tn, fp, fn, tp, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}
        FROM ({metric_row(SCORED, '0.5::DOUBLE')})""",
    "roc_points": f"""SELECT score AS threshold, round(fp::DOUBLE / all_neg, 6) AS fpr, round(tp::DOUBLE / all_pos, 6) AS tpr
        FROM ({score_groups(SCORED)}) UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
    "pr_points": f"""SELECT score AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / all_pos, 6) AS recall
        FROM ({score_groups(SCORED)}) UNION ALL SELECT NULL, 1.0, 0.0""",
    "curve_areas": areas(SCORED),
    "youden": f"SELECT threshold, round(youden_j, 6) AS youden_j FROM ({YOUDEN.format(groups=score_groups(SCORED))})",
    "youden_applied": f"""WITH parts AS ({three_way(SCORED, LINE_ID, 'true_label')}),
        best AS ({YOUDEN.format(groups=score_groups("SELECT * FROM parts WHERE split = 'val'"))})
        SELECT threshold, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc
        FROM ({metric_row("SELECT * FROM parts WHERE split = 'test'", '(SELECT threshold FROM best)')})""",
    "multiclass_confusion": f"""SELECT t AS true_label, p::INT AS pred_label, count(c.vec_id) AS n
        FROM (SELECT unnest(range(10))::INT AS t) CROSS JOIN (SELECT unnest(range(10)) AS p)
        LEFT JOIN ({CLASS_SCORES}) c ON c.true_label = t AND c.pred_label = p GROUP BY ALL""",
    "multiclass_metrics": f"""WITH s AS ({CLASS_SCORES}),
        k AS (SELECT DISTINCT c FROM (SELECT true_label AS c FROM s UNION ALL SELECT pred_label FROM s)),
        per AS (SELECT c, (SELECT count(*) FROM s WHERE true_label = c)::DOUBLE AS t, (SELECT count(*) FROM s WHERE pred_label = c)::DOUBLE AS p,
            (SELECT count(*) FROM s WHERE true_label = c AND pred_label = c)::DOUBLE AS h FROM k),
        m AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE h / p END AS pr, CASE WHEN t = 0 THEN 0 ELSE h / t END AS re, 2 * h / (t + p) AS f FROM per),
        z AS (SELECT sum(t) AS n, sum(h) AS h, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt FROM per)
        SELECT round(any_value(z.h / z.n), 6) AS accuracy, round(avg(re) FILTER (t > 0), 6) AS balanced_accuracy,
            round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, round(avg(f), 6) AS f1_macro,
            round(sum(pr * t) / sum(t), 6) AS precision_weighted, round(sum(re * t) / sum(t), 6) AS recall_weighted,
            round(sum(f * t) / sum(t), 6) AS f1_weighted,
            round(any_value((z.h * z.n - z.pt) / sqrt((z.n * z.n - z.pp) * (z.n * z.n - z.tt))), 6) AS mcc,
            round(any_value((z.h * z.n - z.pt) / (z.n * z.n - z.pt)), 6) AS kappa FROM m, z""",
    "ovr_areas": f"""SELECT round(avg(sum_auc), 6) AS roc_auc_ovr, round(avg(sum_ap), 6) AS pr_auc_macro FROM (
        SELECT class, sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(all_pos)::DOUBLE * any_value(all_neg)) AS sum_auc,
            sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(all_pos) AS sum_ap FROM ({score_groups(OVR, 'class')}) GROUP BY class)""",
    "ovr_roc_points": f"""SELECT class::INT AS class, round(score, 6) AS threshold, round(fp::DOUBLE / all_neg, 6) AS fpr, round(tp::DOUBLE / all_pos, 6) AS tpr
        FROM ({score_groups(OVR, 'class')}) UNION ALL SELECT unnest(range(10))::INT, 'inf'::DOUBLE, 0.0, 0.0""",
    "predictions": f"""SELECT true_label, {', '.join(f'round(q[{i + 1}], 6) AS prob_class_{i}' for i in range(10))},
        pred_label::INT AS pred_label FROM ({CLASS_SCORES})""",
    "model_input": f"SELECT {soft('text')} AS text, toxic::INT AS label FROM {LABELLED}",
    "metric_headers": "SELECT "
    + ", ".join(f'round({m}, 6) AS "{METRIC_HEADERS[m]}"' for m in ["threshold", *METRICS] if m in METRIC_HEADERS and "macro" not in m)
    + f" FROM ({metric_row(SCORED, '0.6::DOUBLE')})",
    "csv_round_trip": f"SELECT doc_id, {soft('text')} AS text, lang FROM documents",
    "split_round_trip": split("SELECT doc_id, lang, source FROM documents", ["doc_id"], "lang", [0.1], ["test", "train"]),
    "stream_clean": f"""WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')}
        SELECT doc_id, {soft('text')} AS tweet_soft, full_text AS tweet_full, (lang IS DISTINCT FROM 'en')::INT AS is_cyberbullying
        FROM documents JOIN cleaned USING (doc_id)""",
    "prepare_language": f"""WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')},
        {identified('SELECT text, lang FROM documents', 'SELECT * FROM documents', 'doc_id')},
        spoken AS (SELECT doc_id, text, CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE 'odd' END AS label
            FROM documents JOIN found USING (doc_id) WHERE language = 'en'),
        chosen_docs AS (SELECT * FROM spoken WHERE doc_id IN ({kept_ids('SELECT * FROM spoken', ['text'], 'label')})),
        parts AS ({three_way('SELECT * FROM chosen_docs', ['doc_id'], 'label')})
        SELECT p.doc_id, p.label AS cyberbullying_type, {soft('text')} AS tweet_soft, full_text AS tweet_full,
            (p.label <> 'even')::INT AS is_cyberbullying, m.code AS cyberbullying_label, p.split
        FROM parts p JOIN cleaned USING (doc_id) JOIN ({ordinal('label', 'chosen_docs')}) m ON m.label = p.label""",
    "prepare_raw": f"""WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')},
        kept AS (SELECT doc_id, text, lang FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id IN ({RAW_KEPT})),
        parts AS ({three_way('SELECT * FROM kept', ['doc_id'], 'lang')})
        SELECT p.doc_id, p.lang AS cyberbullying_type, {soft('text')} AS tweet_soft, full_text AS tweet_full,
            (p.lang <> 'en')::INT AS is_cyberbullying, m.code AS cyberbullying_label, p.split
        FROM parts p JOIN cleaned USING (doc_id) JOIN ({ordinal('lang', 'kept')}) m ON m.lang = p.lang""",
    "prepare_part": f"""WITH {staged_full(FULL_DOCS, 'doc_id', 'cleaned')},
        part AS (SELECT doc_id, text AS tweet_text, nullif({soft('text')}, '') AS tweet_soft, nullif(full_text, '') AS tweet_full, lang AS label
            FROM documents JOIN cleaned USING (doc_id))
        SELECT doc_id, tweet_full, label FROM part WHERE doc_id IN ({kept_ids('SELECT * FROM part', ['tweet_text', 'tweet_soft', 'tweet_full'], 'label')})
            AND tweet_soft IS NOT NULL AND tweet_full IS NOT NULL""",
    "labelled_class_distribution": f"""WITH src AS (SELECT doc_id, text, {soft('text')} AS soft, toxic FROM {LABELLED})
        SELECT toxic, count(*) AS n FROM src WHERE doc_id IN ({kept_ids('SELECT * FROM src', ['text', 'soft'], 'toxic')}) GROUP BY toxic""",
    "group_noise": f"SELECT event_id, round({uniform('event_id', quoted('noise'))}, 9) AS noise FROM events",
}

ENGLISH = f"SELECT doc_id, text, (lang = 'en')::INT AS label, split FROM ({three_way('SELECT * FROM documents', ['doc_id'], 'lang')})"
ORACLE["epoch_metrics"] = f"""WITH {epoch_steps(ENGLISH, 3, 64, 8.0)}
    SELECT epoch, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM per_epoch"""
ORACLE["epoch_scores"] = f"""WITH {epoch_steps(ENGLISH, 3, 64, 8.0)},
    best AS (SELECT epoch FROM per_epoch ORDER BY f1 DESC, epoch LIMIT 1),
    every AS ({' UNION ALL '.join(f'SELECT {e} AS epoch, * FROM p{e}' for e in (1, 2, 3))})
    SELECT doc_id, label, epoch::INT AS epoch, round(p, 6) AS probability FROM every JOIN best USING (epoch) WHERE split = 'test'"""

#: The columns of the metrics file of several classes, under their published headers.
MULTICLASS_COLUMNS = [c for c in METRIC_HEADERS if c in ("accuracy", "balanced_accuracy", "mcc", "kappa") or "macro" in c or c == "roc_auc_ovr"]
ORACLE["judge_multiclass_metrics"] = (
    "SELECT " + ", ".join(f'{c} AS "{METRIC_HEADERS[c]}"' for c in MULTICLASS_COLUMNS)
    + f" FROM ({ORACLE['multiclass_metrics']}), ({ORACLE['ovr_areas']})"
)
ORACLE["judge_multiclass_predictions"] = ORACLE["predictions"]
ORACLE["nearest_by_regions"] = ORACLE["nearest_label"]
