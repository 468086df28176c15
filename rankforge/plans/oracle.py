"""DuckDB SQL for every registered query that SQL can express.

Written independently of the Spark code: plain SQL over the same fixture
views (``sources/fixtures.py``), so a value mismatch points at a real
semantic difference. Float literals are cast to DOUBLE (DuckDB reads 0.75 as
DECIMAL), scores are rounded before ranking and ties broken by id, exactly
as the library documents.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from rankforge.sources.fixtures import with_fixtures

# ---- fixed values, stated again so that the SQL does not depend on the library's ----
LABEL_GRADES = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
HASH_MODELS = {"a": (31, 7), "b": (17, 13)}
# ---- end of fixed values ----

D = "::DOUBLE"
SWEEP_DIMS = (64, 32, 16, 8)
STRATS = (("Dense Only", ("dense",)), ("Dense + BM25", ("dense", "bm25")),
          ("Dense + SPLADE", ("dense", "splade")), ("Dense + BM25 + SPLADE", ("dense", "bm25", "splade")))
WEIGHTS = {"dense": 1.0, "splade": 0.5, "bm25": 0.3}
SRC_CODE = {"dense": 0, "splade": 1, "bm25": 2}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def nfkd_map_sql() -> str:
    """Every character whose lower-case form decomposes into something with an
    ASCII letter or digit, with that decomposition."""
    items = []
    for ch in map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)):
        made = unicodedata.normalize("NFKD", ch.lower())
        if made != ch and any(x.isascii() and x.isalnum() for x in made):
            items.append((ch, made))
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in items) + "}"


def ascii_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[a-z0-9]+', 0)"


def any_tokens(expr: str) -> str:
    """Tokens of any text: pieces with non-ASCII characters are rewritten
    through the NFKD table character by character."""
    m = nfkd_map_sql()
    return (f"regexp_extract_all(array_to_string(list_transform(string_split_regex(lower({expr}), '\\s+'), "
            f"lambda p: CASE WHEN strlen(p) = length(p) THEN p ELSE array_to_string(list_transform("
            f"string_split(p, ''), lambda ch: coalesce(({m})[ch], ch)), '') END), ' '), '[a-z0-9]+', 0)")


def stem_case(col: str) -> str:
    # closed vocabulary of the part-name fixture: only 'large' changes
    return f"CASE WHEN {col} = 'large' THEN 'larg' ELSE {col} END"


# ------------------------------------------------------------------ stems in SQL
# ---- fixed values: suffix rules of the published algorithm, in its order ----
SQL_STEP2 = ("ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,"
             "ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,fulli ful")
SQL_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
SQL_STEP4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"
SQL_IRREGULAR = ("sky sky,skies sky,dying die,lying lie,tying tie,news news,innings inning,inning inning,outings outing,"
                 "outing outing,cannings canning,canning canning,howe howe,proceed proceed,exceed exceed,succeed succeed")
# ---- end of fixed values ----


def sql_form(w: str) -> str:
    """The word with every vowel as 'v' and every consonant as '#': a y counts
    as a consonant at the start and behind a vowel."""
    y = f"regexp_replace(regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    return f"regexp_replace(regexp_replace({y}, '[^aeiouy]', '#', 'g'), '[aeiouy]', 'v', 'g')"


def stem_ctes(prefix: str, words: str) -> str:
    """CTEs ending in {prefix}_stem(t, w): the stem w of every word t of the
    table ``words``. One CTE per step; f is the form of w, so the form of a
    stem of w is a prefix of f and its measure counts 'v#' in it."""
    def left(cut: int) -> str:
        return f"left(f, length(w) - {cut})"

    def m(cut: int) -> str:
        return f"((length({left(cut)}) - length(replace({left(cut)}, 'v#', ''))) / 2)"

    def cvc(cut: int) -> str:
        return (f"(({left(cut)} LIKE '%#v#' AND left(w, length(w) - {cut}) NOT SIMILAR TO '.*[wxy]') OR {left(cut)} = 'v#')")

    def rules(text: str, least: int) -> str:
        out = []
        for rule in text.split(","):
            suffix, _, repl = rule.partition(" ")
            ok = f"{m(len(suffix))} > {least}"
            if rule == "ion":
                ok += " AND left(w, length(w) - 3) SIMILAR TO '.*[st]'"
            out.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {ok} THEN left(w, length(w) - {len(suffix)}) || '{repl}' ELSE w END")
        return " ".join(out)

    def base(name: str, cut: int) -> str:
        return f"w LIKE '%{name}' AND contains({left(cut)}, 'v')"

    step2 = rules(SQL_STEP2, 0)
    steps = [
        "CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN left(w, 1) || 'ie' WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) "
        "WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END",
        # what is left of -ed and -ing goes on in the next step, marked by a blank
        f"CASE WHEN w LIKE '%ied' THEN left(w, length(w) - 3) || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END "
        f"WHEN w LIKE '%eed' THEN CASE WHEN {m(3)} > 0 THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN {base('ed', 2)} THEN left(w, length(w) - 2) || ' ' WHEN {base('ing', 3)} THEN left(w, length(w) - 3) || ' ' ELSE w END",
        f"CASE WHEN w NOT LIKE '% ' THEN w WHEN w SIMILAR TO '.*(at|bl|iz) ' THEN left(w, length(w) - 1) || 'e' "
        f"WHEN right({left(1)}, 2) = '##' AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) "
        f"THEN left(w, length(w) - CASE WHEN substr(w, length(w) - 1, 1) IN ('l', 's', 'z') THEN 1 ELSE 2 END) "
        f"WHEN {m(1)} = 1 AND {cvc(1)} THEN left(w, length(w) - 1) || 'e' ELSE left(w, length(w) - 1) END",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND {left(1)} LIKE '%#' THEN left(w, length(w) - 1) || 'i' ELSE w END",
        # -alli becomes -al first and step 2 begins again
        f"CASE WHEN w LIKE '%alli' AND {m(4)} > 0 THEN left(w, length(w) - 2) ELSE w END",
        f"CASE {step2} WHEN w LIKE '%logi' THEN CASE WHEN {m(3)} > 0 THEN left(w, length(w) - 1) ELSE w END ELSE w END",
        f"CASE {rules(SQL_STEP3, 0)} ELSE w END",
        f"CASE {rules(SQL_STEP4, 1)} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {cvc(1)})) THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {m(1)} > 1 THEN left(w, length(w) - 1) ELSE w END",
    ]
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (x.split(" ") for x in SQL_IRREGULAR.split(",")))
    parts = [f"{prefix}_s0 AS (SELECT DISTINCT w AS t, w FROM {words})"]
    for i, step in enumerate(steps):
        parts.append(f"{prefix}_s{i + 1} AS (SELECT t, {step} AS w FROM (SELECT t, w, {sql_form('w')} AS f FROM {prefix}_s{i}) x)")
    parts.append(f"{prefix}_stem AS (SELECT t, CASE t {irregular} ELSE CASE WHEN length(t) <= 2 THEN t ELSE w END END AS w "
                 f"FROM {prefix}_s{len(steps)})")
    return ",\n".join(parts)


# ------------------------------------------------------------------ pair table chain
def _clean(c: str) -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {c} IS NULL OR lower({t}) IN ('none', 'nan', '') THEN '' ELSE {t} END"


GRADE_CASE = "CASE esci_label " + " ".join(f"WHEN '{k}' THEN {v}{D}" for k, v in LABEL_GRADES.items()) + " END"

PAIRS_CTES = f"""
j AS (SELECT e.example_id, e.query, e.query_id, e.product_id, e.product_locale, e.esci_label,
             e.small_version, e.split, p.product_title, p.product_brand, p.product_bullet_point
      FROM fx_examples e LEFT JOIN fx_products p
        ON e.product_locale = p.product_locale AND e.product_id = p.product_id),
f1 AS (SELECT * FROM j WHERE product_locale = 'us' AND small_version = 1),
f2 AS (SELECT * FROM f1 WHERE query IS NULL OR strlen(query) = length(query)),
f3 AS (SELECT * EXCLUDE (has_e) FROM (
         SELECT *, max(CASE WHEN esci_label = 'E' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY product_locale, query_id) AS has_e FROM f2) t WHERE has_e = 1),
ov AS (SELECT DISTINCT a.query_id
       FROM (SELECT DISTINCT query_id, product_locale FROM f3 WHERE split = 'train') a
       JOIN (SELECT DISTINCT query_id, product_locale FROM f3 WHERE split = 'test') b
         ON a.query_id = b.query_id AND a.product_locale = b.product_locale),
f4 AS (SELECT * FROM f3 WHERE NOT coalesce(split = 'train' AND query_id IN (SELECT query_id FROM ov), false)),
cl AS (SELECT *, {_clean('product_title')} AS c_title, {_clean('product_brand')} AS c_brand,
              {_clean('product_bullet_point')} AS c_bullets FROM f4),
pairs AS (
  SELECT example_id, query_id, product_id, product_locale, query, esci_label, {GRADE_CASE} AS grade,
         split, product_title,
         concat_ws(' ', CASE WHEN c_title <> '' THEN c_title || '.' END,
                        CASE WHEN c_brand <> '' THEN c_brand END,
                        CASE WHEN c_bullets <> '' THEN c_bullets END) AS product_text_dense
  FROM cl WHERE esci_label IN ('E', 'S', 'C', 'I')),
tp AS (SELECT * FROM pairs WHERE split = 'test'),
uprod AS (SELECT product_id, product_title, product_text_dense FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY example_id) AS rn FROM tp) t WHERE rn = 1),
uq AS (SELECT query_id, query FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY example_id) AS rn FROM tp) t WHERE rn = 1),
gq AS (SELECT * FROM uq WHERE query_id IN (SELECT query_id FROM tp WHERE grade >= 0.1{D})),
glk AS (SELECT query_id, product_id, grade FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY example_id DESC) AS rn
            FROM tp) t WHERE rn = 1)"""


def pairs_sql(body: str, extra_ctes: str = "") -> str:
    ctes = PAIRS_CTES + ("," + extra_ctes if extra_ctes else "")
    return with_fixtures(f"WITH {ctes}\n{body}", "fx_examples", "fx_products")


# ------------------------------------------------------------------ retrieval pieces (test split)
def bm25_ctes(prefix: str, docs_sql: str, queries_sql: str, tokens, stem, k: int) -> str:
    """CTEs {prefix}_list(query_id, product_id, score, rank) of a BM25 search."""
    st, stems = "w", ""
    if stem == "closed":  # closed vocabulary of the part names
        st = stem_case("w")
    elif stem:
        stems = f"""
{prefix}_words AS (SELECT w FROM {prefix}_dt UNION SELECT w FROM {prefix}_qt),
{stem_ctes(prefix, prefix + '_words')},"""
    dt = f"(SELECT d.doc_id, s.w FROM {prefix}_dt d JOIN {prefix}_stem s ON s.t = d.w)" if stems else f"{prefix}_dt"
    qt = f"(SELECT d.query_id, s.w FROM {prefix}_qt d JOIN {prefix}_stem s ON s.t = d.w)" if stems else f"{prefix}_qt"
    return f"""
{prefix}_docs AS ({docs_sql}),
{prefix}_dt AS (SELECT doc_id, unnest({tokens('text')}) AS w FROM {prefix}_docs),
{prefix}_qs AS ({queries_sql}),
{prefix}_qt AS (SELECT query_id, unnest({tokens("coalesce(query, 'None')")}) AS w FROM {prefix}_qs),{stems}
{prefix}_tf AS (SELECT doc_id, {st} AS term, count(*) AS tf FROM {dt} x GROUP BY ALL),
{prefix}_dl AS (SELECT doc_id, sum(tf) AS dl FROM {prefix}_tf GROUP BY doc_id),
{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term),
{prefix}_st AS (SELECT count(*){D} AS n,
                  coalesce((SELECT sum(tf) FROM {prefix}_tf), 0){D} / count(*){D} AS avgdl FROM {prefix}_docs),
{prefix}_qtf AS (SELECT query_id, {st} AS term, count(*) AS qtf FROM {qt} x GROUP BY ALL),
{prefix}_sc AS (
  SELECT q.query_id, t.doc_id AS product_id,
         round(sum(q.qtf{D} * ((t.tf{D} * 2.5{D}) / (t.tf{D} + 1.5{D} * (0.25{D} + 0.75{D} * l.dl{D} / greatest(s.avgdl, 1e-9{D})))
                               * ln((s.n - f.df{D} + 0.5{D}) / (f.df{D} + 0.5{D}) + 1.0{D}))), 9) AS score
  FROM {prefix}_qtf q JOIN {prefix}_tf t ON q.term = t.term JOIN {prefix}_dl l ON l.doc_id = t.doc_id
       JOIN {prefix}_df f ON f.term = q.term CROSS JOIN {prefix}_st s
  GROUP BY q.query_id, t.doc_id),
{prefix}_list AS (SELECT * FROM (
  SELECT query_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) - 1 AS INTEGER) AS rank
  FROM {prefix}_sc) t WHERE rank < {k})"""


def splade_ctes(k: int = 500) -> str:
    return f"""
sp_dt AS (SELECT product_id AS doc_id, unnest({ascii_tokens("coalesce(product_text_dense, '')")}) AS term FROM uprod),
sp_dw AS (SELECT doc_id, term, ln(1 + count(*)){D} AS weight FROM sp_dt GROUP BY ALL),
sp_qt AS (SELECT query_id, unnest({ascii_tokens("coalesce(query, 'None')")}) AS term FROM gq),
sp_qw AS (SELECT query_id, term, ln(1 + count(*)){D} AS qw FROM sp_qt GROUP BY ALL),
sp_sc AS (SELECT q.query_id, d.doc_id AS product_id, round(sum(q.qw * d.weight), 9) AS score
          FROM sp_qw q JOIN sp_dw d ON q.term = d.term GROUP BY ALL),
sp_list AS (SELECT * FROM (
  SELECT query_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) - 1 AS INTEGER) AS rank
  FROM sp_sc) t WHERE rank < {k})"""


def hash_vec(text_expr: str, dim: int = 64, model: str = "a") -> str:
    m1, m2 = HASH_MODELS[model]
    toks = ascii_tokens(text_expr)
    return (f"list_transform(range({dim}), lambda i: len(list_filter({toks}, lambda t: "
            f"(ascii(t) * {m1} + length(t) * {m2} + ascii(reverse(t))) % {dim} = i)){D})")


def norm_prefix(vec: str, dim: int) -> str:
    v = f"list_slice({vec}, 1, {dim})"
    return (f"list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), "
            f"1e-10{D}))")


def dense_ctes(prefix: str, dims, k: int = 500, model: str = "a") -> str:
    instr = _q(QUERY_INSTRUCTION)
    parts = [f"""
{prefix}_pv AS (SELECT product_id, {hash_vec('product_text_dense', 64, model)} AS v FROM uprod),
{prefix}_qv AS (SELECT query_id, {hash_vec(f"{instr} || coalesce(query, 'None')", 64, model)} AS v FROM gq)"""]
    for d in dims:
        parts.append(f"""
{prefix}_{d}_sc AS (SELECT q.query_id, p.product_id,
         round(list_sum(list_transform(list_zip({norm_prefix('q.v', d)}, {norm_prefix('p.v', d)}), lambda z: z[1] * z[2])), 9) AS score
  FROM {prefix}_qv q CROSS JOIN {prefix}_pv p),
{prefix}_{d}_list AS (SELECT * FROM (
  SELECT query_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) - 1 AS INTEGER) AS rank
  FROM {prefix}_{d}_sc) t WHERE rank < {k})""")
    return ",".join(parts)


def fuse_sql(lists: dict, top: int = 200, weights=WEIGHTS, rrf_k: int = 60) -> str:
    """SELECT of fused (query_id, product_id, rrf_score, rank) from ranked-list CTE names."""
    union = " UNION ALL ".join(f"SELECT query_id, product_id, rank, '{s}' AS source FROM {name}"
                               for s, name in lists.items())
    terms = " + ".join(
        f"coalesce(sum(CASE WHEN source = '{s}' THEN {weights.get(s, 0.0)}{D} * (1.0{D} / (({rrf_k} + rank + 1){D})) END), 0.0{D})"
        for s in ("dense", "splade", "bm25"))
    code = "CASE source " + " ".join(f"WHEN '{s}' THEN {c}" for s, c in SRC_CODE.items()) + " END"
    return f"""SELECT * FROM (
  SELECT query_id, product_id, rrf_score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first_seen) - 1 AS INTEGER) AS rank
  FROM (SELECT query_id, product_id, {terms} AS rrf_score, min({code} * 1000000 + rank) AS first_seen
        FROM ({union}) u GROUP BY query_id, product_id) a) b WHERE rank < {top}"""


TITLE_DOCS = "SELECT product_id AS doc_id, coalesce(product_title, '') AS text FROM uprod"


def candidate_ctes() -> str:
    return ",".join([
        dense_ctes("dn", (64,)),
        bm25_ctes("bm", TITLE_DOCS, "SELECT query_id, query FROM gq", ascii_tokens, "closed", 500),
        splade_ctes(500),
        f"""
fused AS ({fuse_sql({'dense': 'dn_64_list', 'bm25': 'bm_list', 'splade': 'sp_list'})}),
cands AS (SELECT f.query_id, f.product_id, coalesce(g.grade, 0.0{D}) AS grade, f.rrf_score, q.query,
                 coalesce(p.product_text_dense, '') AS product_text_dense, f.rank
          FROM fused f LEFT JOIN glk g ON f.query_id = g.query_id AND f.product_id = g.product_id
          JOIN uq q ON q.query_id = f.query_id
          LEFT JOIN uprod p ON p.product_id = f.product_id)"""])


def metric_ctes(cands: str = "cands", score: str = "rrf_score", qrels: str = "tp", sfx: str = "") -> str:
    rk = (50, 100, 200)
    nk = (10, 20, 50)
    hits = ", ".join(f"sum(CASE WHEN pos <= {k} AND grade >= 0.1{D} THEN 1 ELSE 0 END) AS hits_{k}" for k in rk)
    dcg = ", ".join(f"coalesce(sum(CASE WHEN pos <= {k} THEN (pow(2.0{D}, grade) - 1.0{D}) / log2(pos + 1.0{D}) END), 0.0{D}) AS dcg_{k}" for k in nk)
    idcg = ", ".join(f"sum(CASE WHEN ipos <= {k} THEN (pow(2.0{D}, grade) - 1.0{D}) / log2(ipos + 1.0{D}) END) AS idcg_{k}" for k in nk)
    rec = ", ".join(f"CASE WHEN n_rel > 0 THEN hits_{k}{D} / n_rel END AS recall_{k}" for k in rk)
    nd = ", ".join(f"CASE WHEN coalesce(n_pos, 0) > 0 THEN CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0.0{D} END END AS ndcg_{k}" for k in nk)
    return f"""
cr{sfx} AS (SELECT query_id, product_id, coalesce(grade, 0.0{D}) AS grade,
              row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, product_id) AS pos FROM {cands}),
got{sfx} AS (SELECT query_id, {hits}, {dcg} FROM cr{sfx} GROUP BY query_id),
ideal{sfx} AS (SELECT query_id, count(*) AS n_pos, {idcg} FROM (
            SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS ipos
            FROM {qrels} WHERE grade > 0) t GROUP BY query_id),
rel{sfx} AS (SELECT query_id, sum(CASE WHEN grade >= 0.1{D} THEN 1 ELSE 0 END) AS n_rel FROM {qrels} GROUP BY query_id),
pq{sfx} AS (SELECT g.query_id, {rec}, {nd}
       FROM got{sfx} g JOIN (SELECT r.query_id, r.n_rel, i.* EXCLUDE (query_id) FROM rel{sfx} r
                             LEFT JOIN ideal{sfx} i ON r.query_id = i.query_id) s
         ON g.query_id = s.query_id)"""


def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


MEANS = ", ".join([f"round(coalesce(avg(recall_{k}), 0.0{D}), 6) AS recall_{k}" for k in (50, 100, 200)]
                  + [f"round(coalesce(avg(ndcg_{k}), 0.0{D}), 6) AS ndcg_{k}" for k in (10, 20, 50)]
                  + ["count(recall_50) AS n_recall_queries", "count(ndcg_10) AS n_ndcg_queries"])

OVERLAP_SCORE = (
    "coalesce(len(list_intersect(list_distinct({q}), list_distinct({t}))){D} / nullif(len(list_distinct({q})), 0){D}, 0.0{D})"
    " + len(list_intersect(list_distinct({q}), list_distinct({t}))){D} * 0.001{D}")


def overlap_score(q: str, t: str) -> str:
    return OVERLAP_SCORE.format(q=ascii_tokens(f"coalesce({q}, 'None')"), t=ascii_tokens(f"coalesce({t}, '')"), D=D)


def default_runs():
    """(name, dim, sources, weights, rrf_k) of the strategy x dimension grid."""
    return [(name, d, srcs, WEIGHTS, 60) for name, srcs in STRATS for d in SWEEP_DIMS]


def sweep_ctes(prefix: str, model: str, runs=None) -> str:
    runs = runs if runs is not None else default_runs()
    dims = sorted({r[1] for r in runs}, reverse=True)
    lists = [dense_ctes(f"{prefix}dn", dims, 500, model),
             bm25_ctes(f"{prefix}bm", TITLE_DOCS, "SELECT query_id, query FROM gq", ascii_tokens, "closed", 500)]
    parts = []
    for name, d, srcs, weights, k in runs:
        src_map = {"dense": f"{prefix}dn_{d}_list"}
        if "bm25" in srcs:
            src_map["bm25"] = f"{prefix}bm_list"
        if "splade" in srcs:
            src_map["splade"] = "sp_list"
        parts.append(f"SELECT {_q(name)} AS strategy, {d} AS dimension, {_q(','.join(srcs))} AS sources, * "
                     f"FROM ({fuse_sql(src_map, weights=weights, rrf_k=k)}) x")
    body = f"""
{prefix}runs AS ({' UNION ALL '.join(parts)}),
{prefix}rc AS (SELECT r.strategy, r.dimension, r.sources, r.query_id, r.product_id, r.rrf_score, coalesce(g.grade, 0.0{D}) AS grade,
               row_number() OVER (PARTITION BY r.strategy, r.dimension, r.query_id ORDER BY r.rrf_score DESC, r.product_id) AS pos
            FROM {prefix}runs r LEFT JOIN glk g ON r.query_id = g.query_id AND r.product_id = g.product_id),
{prefix}got AS (SELECT strategy, dimension, sources, query_id,
    {", ".join(f"sum(CASE WHEN pos <= {k} AND grade >= 0.1{D} THEN 1 ELSE 0 END) AS hits_{k}" for k in (50, 100, 200))},
    {", ".join(f"coalesce(sum(CASE WHEN pos <= {k} THEN (pow(2.0{D}, grade) - 1.0{D}) / log2(pos + 1.0{D}) END), 0.0{D}) AS dcg_{k}" for k in (10, 20, 50))}
    FROM {prefix}rc GROUP BY ALL),
{prefix}pq AS (SELECT g.strategy, g.dimension, g.sources, g.query_id,
    {", ".join(f"CASE WHEN n_rel > 0 THEN hits_{k}{D} / n_rel END AS recall_{k}" for k in (50, 100, 200))},
    {", ".join(f"CASE WHEN coalesce(n_pos, 0) > 0 THEN CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0.0{D} END END AS ndcg_{k}" for k in (10, 20, 50))}
    FROM {prefix}got g JOIN (SELECT r.query_id, r.n_rel, i.* EXCLUDE (query_id) FROM rel r LEFT JOIN ideal i ON r.query_id = i.query_id) s
      ON g.query_id = s.query_id),
{prefix}sweep AS (SELECT strategy, dimension, sources, {MEANS.replace(', count(recall_50) AS n_recall_queries, count(ndcg_10) AS n_ndcg_queries', '')}
    FROM {prefix}pq GROUP BY strategy, dimension, sources)"""
    return ",".join(lists) + "," + body


def sweep_base_ctes() -> str:
    # judged summaries of the test split (ideal / rel) + the learned-sparse list
    m = metric_ctes("tp")
    keep = m[m.index("ideal AS"):m.index("pq AS")].rstrip().rstrip(",")
    return splade_ctes(500) + ",\n" + keep


def sweep_sql(select: str, models=("a",), runs=None) -> str:
    ctes = sweep_base_ctes()
    for m in models:
        ctes += "," + sweep_ctes(f"s{m}_", m, runs)
    return pairs_sql(select, ctes)


SWEEP_COLS = "recall_50, recall_100, recall_200, ndcg_10, ndcg_20, ndcg_50"


@lru_cache(maxsize=1)
def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    f2_cols = ["product_locale", "product_id", "example_id", "query", "query_id", "esci_label",
               "small_version", "split", "product_title", "product_brand", "product_bullet_point"]
    q["scan_profile_nulls"] = pairs_sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM f2" for c in f2_cols))
    q["label_distribution"] = pairs_sql("SELECT esci_label, count(*) AS n FROM f2 GROUP BY esci_label")
    q["pairs_left_join"] = pairs_sql(
        "SELECT example_id, query_id, product_id, product_locale, esci_label, split, product_title, product_brand FROM f1")
    q["ascii_filter"] = "SELECT conv_id, turn FROM conversations WHERE text IS NULL OR strlen(text) = length(text)"
    q["queries_with_exact"] = pairs_sql("SELECT example_id, query_id, product_locale, esci_label FROM f3")
    overlap = """
WITH tr AS (SELECT DISTINCT query_id, product_locale FROM fx_examples WHERE split = 'train'),
     te AS (SELECT DISTINCT query_id, product_locale FROM fx_examples WHERE split = 'test'),
     ov AS (SELECT DISTINCT tr.query_id, tr.product_locale FROM tr JOIN te
              ON tr.query_id = te.query_id AND tr.product_locale = te.product_locale)
SELECT example_id, query_id, split FROM fx_examples e
WHERE NOT coalesce(split = 'train' AND {cond}, false)"""
    q["overlap_removed"] = with_fixtures(overlap.format(cond="query_id IN (SELECT query_id FROM ov)"), "fx_examples")
    q["overlap_removed_by_locale"] = with_fixtures(overlap.format(
        cond="EXISTS (SELECT 1 FROM ov WHERE ov.query_id = e.query_id AND ov.product_locale = e.product_locale)"),
        "fx_examples")
    q["product_text"] = pairs_sql(f"""SELECT example_id, concat_ws(' ', CASE WHEN t <> '' THEN t || '.' END,
        CASE WHEN b <> '' THEN b END, CASE WHEN u <> '' THEN u END) AS product_text_dense
        FROM (SELECT example_id, {_clean('product_title')} AS t, {_clean('product_brand')} AS b,
                     {_clean('product_bullet_point')} AS u FROM f1) x""")
    q["product_text_color"] = pairs_sql(f"""SELECT example_id, concat_ws(' ', CASE WHEN t <> '' THEN t || '.' END,
        CASE WHEN b <> '' THEN b END, CASE WHEN u <> '' THEN u END, CASE WHEN t <> '' THEN split_part(t, ' ', 1) END) AS product_text_dense
        FROM (SELECT example_id, {_clean('product_title')} AS t, {_clean('product_brand')} AS b,
                     {_clean('product_bullet_point')} AS u FROM f1) x""")
    q["pair_view"] = pairs_sql("SELECT * FROM pairs")
    q["unique_products"] = pairs_sql("SELECT * FROM uprod")
    q["unique_queries"] = pairs_sql("SELECT * FROM uq")
    q["train_pairs"] = pairs_sql(f"""SELECT {_q(QUERY_INSTRUCTION)} || coalesce(query, 'None') AS sentence_A,
        product_text_dense AS sentence_B FROM pairs WHERE split = 'train' AND esci_label IN ('E', 'S')""")
    tok = "(len(regexp_extract_all(coalesce(product_text_dense, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]', 0)) + 2)"
    pcts = (50, 75, 90, 95, 99)
    q["token_length_profile"] = pairs_sql(f"""
SELECT 'mean' AS stat, round(avg(n), 6) AS value, NULL::VARCHAR AS status FROM tl
UNION ALL SELECT 'median', round(quantile_cont(n, 0.5), 6), NULL FROM tl
UNION ALL SELECT 'min', round(min(n), 6), NULL FROM tl
UNION ALL SELECT 'max', round(max(n), 6), NULL FROM tl
UNION ALL """ + " UNION ALL ".join(
        f"SELECT 'p{p}', round(quantile_cont(n, {p / 100}), 6), CASE WHEN quantile_cont(n, {p / 100}) <= 256 "
        f"THEN 'Safe' ELSE 'Truncated' END FROM tl" for p in pcts),
        f"\ntl AS (SELECT {tok}{D} AS n FROM pairs)")
    q["sampled_queries"] = pairs_sql("""SELECT example_id, query_id FROM f2 WHERE query_id IN (
        SELECT query_id FROM (SELECT DISTINCT query_id FROM f2) d
        ORDER BY md5(concat_ws(':', CAST(query_id AS VARCHAR), '0')) LIMIT 10)""")
    for name, t in (("relevant_sets", "0.1"), ("strict_relevant", "0.99")):
        q[name] = pairs_sql(f"SELECT DISTINCT query_id, product_id FROM pairs WHERE grade >= {t}{D}")
    q["grade_lists"] = pairs_sql(
        "SELECT query_id, CAST(count(*) AS INTEGER) AS n_grades, round(sum(grade), 6) AS grade_sum, "
        "string_agg(CAST(grade AS VARCHAR), ' ' ORDER BY grade) AS grades FROM pairs GROUP BY query_id")
    q["relevant_arrays"] = pairs_sql(f"SELECT query_id, string_agg(product_id, ' ' ORDER BY product_id) AS relevant FROM "
                                     f"(SELECT DISTINCT query_id, product_id FROM pairs WHERE grade >= 0.1{D}) t GROUP BY query_id")
    q["distinct_query_counts"] = pairs_sql("""
SELECT 'total' AS scope, 'all' AS key, count(DISTINCT query_id) AS queries FROM pairs
UNION ALL SELECT 'locale', product_locale, count(DISTINCT query_id) FROM pairs GROUP BY product_locale
UNION ALL SELECT 'split', split, count(DISTINCT query_id) FROM pairs GROUP BY split""")
    q["gatekeeper"] = pairs_sql("SELECT query_id FROM gq")
    q["grade_lookup"] = pairs_sql("SELECT * FROM glk")

    bm = bm25_ctes("bm", TITLE_DOCS, "SELECT query_id, query FROM gq", ascii_tokens, "closed", 500)
    q["bm25_doc_freq"] = pairs_sql("SELECT term, df FROM bm_df", bm)
    q["bm25_stats"] = pairs_sql(
        "SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM bm_df) AS n_terms FROM bm_st", bm)
    q["bm25_weights"] = pairs_sql(f"""SELECT t.doc_id, t.term, t.tf, CAST(l.dl AS BIGINT) AS dl, f.df,
        round((t.tf{D} * 2.5{D}) / (t.tf{D} + 1.5{D} * (0.25{D} + 0.75{D} * l.dl{D} / greatest(s.avgdl, 1e-9{D})))
              * ln((s.n - f.df{D} + 0.5{D}) / (f.df{D} + 0.5{D}) + 1.0{D}), 6) AS weight
        FROM bm_tf t JOIN bm_dl l ON t.doc_id = l.doc_id JOIN bm_df f ON f.term = t.term CROSS JOIN bm_st s""", bm)
    ranked_sel = "SELECT query_id, '{src}' AS source, product_id, score, rank FROM {lst}"
    q["bm25_topk"] = pairs_sql(ranked_sel.format(src="bm25", lst="bm_list"), bm)
    bmu = bm25_ctes("bm", TITLE_DOCS, "SELECT query_id, query FROM gq", ascii_tokens, False, 500)
    q["bm25_topk_unstemmed"] = pairs_sql(ranked_sel.format(src="bm25", lst="bm_list"), bmu)
    bd = bm25_ctes("bd", "SELECT doc_id, coalesce(text, '') AS text FROM documents",
                   "SELECT item_id AS query_id, text AS query FROM benchmark", any_tokens, False, 100)
    q["bm25_docs_topk"] = f"WITH {bd}\n" + ranked_sel.format(src="bm25", lst="bd_list")
    bs = bm25_ctes("bd", "SELECT doc_id, coalesce(text, '') AS text FROM documents",
                   "SELECT item_id AS query_id, text AS query FROM benchmark", any_tokens, True, 100)
    q["bm25_docs_stemmed_topk"] = f"WITH {bs}\n" + ranked_sel.format(src="bm25", lst="bd_list")
    doc_toks = any_tokens("coalesce(text, '')")
    q["stem_dictionary"] = (f"WITH dw AS (SELECT doc_id, unnest({doc_toks}) AS w FROM documents),\n{stem_ctes('dw', 'dw')}\n"
                            "SELECT t AS term, s.w AS stem, count(DISTINCT doc_id) AS n_rows FROM dw JOIN dw_stem s ON s.t = dw.w GROUP BY ALL")
    q["stemmed_counts"] = (f"WITH dw AS (SELECT doc_id, unnest({doc_toks}) AS w FROM documents),\n{stem_ctes('dw', 'dw')}\n"
                           "SELECT doc_id, s.w AS term, count(*) AS tf FROM dw JOIN dw_stem s ON s.t = dw.w GROUP BY ALL")
    q["doc_term_counts"] = (f"SELECT doc_id, CAST(len(tk) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tk)) AS INTEGER) AS n_distinct "
                            f"FROM (SELECT doc_id, {doc_toks} AS tk FROM documents) t")

    vp = []
    for d in SWEEP_DIMS:
        nv = norm_prefix("embedding::DOUBLE[]", d)
        vp.append(f"SELECT product_id, {d} AS dim, round(v[1], 6) AS c0, round(list_sum(v), 6) AS total, "
                  f"round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm "
                  f"FROM (SELECT vec_id AS product_id, {nv} AS v FROM embeddings) t")
    q["vector_prefix_norm"] = " UNION ALL ".join(vp)
    for d in SWEEP_DIMS:
        q[f"dense_topk_{d}"] = with_fixtures(f"""
SELECT query_id, 'dense' AS source, product_id, score, rank FROM (
  SELECT query_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) - 1 AS INTEGER) AS rank
  FROM (SELECT q.query_id, p.product_id,
               round(list_sum(list_transform(list_zip({norm_prefix('q.embedding::DOUBLE[]', d)},
                     {norm_prefix('p.embedding::DOUBLE[]', d)}), lambda z: z[1] * z[2])), 9) AS score
        FROM fx_vec_queries q CROSS JOIN fx_vec_products p) s) t WHERE rank < 100""",
                                              "fx_vec_queries", "fx_vec_products")
    q["ivf_all_probes"] = q["dense_topk_64"]
    # the approximate list has no SQL; its exact counterpart has: k rows (or all) for every query
    q["ivf_recall"] = """
WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, least(100, (SELECT count(*) FROM embeddings)) AS n FROM q)
SELECT count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_exact, true AS recall_reached FROM s"""
    dv = f"""
dl AS (SELECT * FROM (
  SELECT query_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) - 1 AS INTEGER) AS rank
  FROM (SELECT q.query_id, p.product_id,
               round(list_sum(list_transform(list_zip({norm_prefix('q.embedding::DOUBLE[]', 64)},
                     {norm_prefix('p.embedding::DOUBLE[]', 64)}), lambda z: z[1] * z[2])), 9) AS score
        FROM fx_vec_queries q CROSS JOIN fx_vec_products p) s) t WHERE rank < 500),
fused AS ({fuse_sql({'dense': 'dl'})}),
cands AS (SELECT f.*, g.grade FROM fused f LEFT JOIN fx_vec_qrels g
            ON f.query_id = g.query_id AND f.product_id = g.product_id),"""
    q["dense_vector_metrics"] = with_fixtures(
        "WITH " + dv + metric_ctes("cands", "rrf_score", "fx_vec_qrels")
        + "\nSELECT query_id, " + ", ".join(r6(c) for c in
                                            ("recall_50", "recall_100", "recall_200", "ndcg_10", "ndcg_20", "ndcg_50"))
        + " FROM pq", "fx_vec_queries", "fx_vec_products", "fx_vec_qrels")
    q["sparse_activation"] = f"""
WITH tk AS (SELECT doc_id, {any_tokens("coalesce(text, '')")} AS toks FROM documents),
ex AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM tk),
lg AS (SELECT doc_id, term, ((ascii(term) * 7 + length(term) * 3 + pos) % 11 - 4){D} AS logit FROM ex)
SELECT doc_id, term, round(max(ln(1.0{D} + greatest(logit, 0.0{D}))), 6) AS weight
FROM lg GROUP BY doc_id, term HAVING max(ln(1.0{D} + greatest(logit, 0.0{D}))) > 0"""
    q["learned_sparse_topk"] = pairs_sql(ranked_sel.format(src="splade", lst="sp_list"), splade_ctes(500))

    two = ",".join([dense_ctes("dn", (64,)),
                    bm25_ctes("bm", TITLE_DOCS, "SELECT query_id, query FROM gq", ascii_tokens, "closed", 500)])
    q["rrf_two"] = pairs_sql(
        f"SELECT query_id, product_id, round(rrf_score, 9) AS rrf_score, rank FROM ({fuse_sql({'dense': 'dn_64_list', 'bm25': 'bm_list'})}) f", two)
    three = two + "," + splade_ctes(500)
    q["rrf_three"] = pairs_sql(
        f"SELECT query_id, product_id, round(rrf_score, 9) AS rrf_score, rank FROM ({fuse_sql({'dense': 'dn_64_list', 'bm25': 'bm_list', 'splade': 'sp_list'})}) f", three)
    cc = candidate_ctes()
    q["candidates"] = pairs_sql("SELECT query_id, product_id, grade, round(rrf_score, 9) AS rrf_score, query, "
                                "product_text_dense FROM cands", cc)
    mc = cc + "," + metric_ctes()
    q["recall_at_k"] = pairs_sql("SELECT query_id, " + ", ".join(r6(f"recall_{k}") for k in (50, 100, 200)) + " FROM pq", mc)
    q["ndcg_at_k"] = pairs_sql("SELECT query_id, " + ", ".join(r6(f"ndcg_{k}") for k in (10, 20, 50)) + " FROM pq", mc)
    q["dcg_at_k"] = pairs_sql("SELECT query_id, " + ", ".join(r6(f"dcg_{k}") for k in (10, 20, 50)) + " FROM got", mc)
    self_ideal = ", ".join(
        f"CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0.0{D} END AS ndcg_{k}" for k in (10, 20, 50))
    q["ndcg_self_ideal"] = pairs_sql(f"""SELECT query_id, {", ".join(f"round(ndcg_{k}, 6) AS ndcg_{k}" for k in (10, 20, 50))}
FROM (SELECT query_id, {self_ideal} FROM (
  SELECT query_id,
    {", ".join(f"coalesce(sum(CASE WHEN pos <= {k} THEN (pow(2.0{D}, grade) - 1.0{D}) / log2(pos + 1.0{D}) END), 0.0{D}) AS d{k}" for k in (10, 20, 50))},
    {", ".join(f"coalesce(sum(CASE WHEN ipos <= {k} THEN (pow(2.0{D}, grade) - 1.0{D}) / log2(ipos + 1.0{D}) END), 0.0{D}) AS i{k}" for k in (10, 20, 50))}
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS ipos FROM cr) x GROUP BY query_id) y) z""", mc)
    q["evaluate"] = pairs_sql(f"SELECT {MEANS} FROM pq", mc)

    rr = cc + f""",
rr AS (SELECT *, {overlap_score('query', 'product_text_dense')} AS ce_score FROM cands WHERE rank < 50)"""
    q["rerank_overlap"] = pairs_sql("SELECT query_id, product_id, round(ce_score, 6) AS ce_score FROM rr", rr)
    rr_means = ", ".join(f"round(coalesce(avg(ndcg_{k}), 0.0{D}), 6) AS ndcg_{k}" for k in (10, 20, 50)) + \
        ", count(ndcg_10) AS n_ndcg_queries"
    rrm = rr + "," + metric_ctes("rr", "ce_score")
    q["rerank_eval"] = pairs_sql(f"SELECT {rr_means} FROM pq", rrm)
    m2 = metric_ctes("rr", "ce_score", sfx="2")
    sc = mc + rr[len(cc):] + "," + m2
    q["stage_comparison"] = pairs_sql(f"""
SELECT '1. Retrieval' AS stage, {", ".join(f"round(coalesce(avg(ndcg_{k}), 0.0{D}), 6) AS ndcg_{k}" for k in (10, 20, 50))},
       round(coalesce(avg(recall_100), 0.0{D}), 6) AS recall_100, round(coalesce(avg(recall_200), 0.0{D}), 6) AS recall_200 FROM pq
UNION ALL
SELECT '2. Reranking', {", ".join(f"round(coalesce(avg(ndcg_{k}), 0.0{D}), 6)" for k in (10, 20, 50))}, NULL, NULL FROM pq2""", sc)

    # API-5: all fixture queries as ad-hoc strings against the test products
    sq = ",".join([
        dense_ctes("dn", (64,), 200).replace("FROM gq)", "FROM aq)"),
        bm25_ctes("bm", TITLE_DOCS, "SELECT query_id, query FROM aq", ascii_tokens, "closed", 200),
        splade_ctes(200).replace("FROM gq)", "FROM aq)"),
        f"""
fused AS ({fuse_sql({'dense': 'dn_64_list', 'bm25': 'bm_list', 'splade': 'sp_list'}, top=50,
                    weights={'dense': 1.0, 'splade': 0.7, 'bm25': 0.3})}),
sc AS (SELECT f.query_id, f.rank, p.product_title,
              round({overlap_score('a.query', 'p.product_text_dense')}, 3) AS rerank_score
       FROM fused f JOIN aq a ON a.query_id = f.query_id LEFT JOIN uprod p ON p.product_id = f.product_id)"""])
    q["search_page"] = pairs_sql(
        """SELECT query_id, position, rerank_score, product_title FROM (
             SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) - 1 AS INTEGER) AS position,
                    rerank_score, product_title FROM sc) t WHERE position < 10""",
        "\naq AS (SELECT query_id, query FROM fx_queries)," + sq)

    q["search_page_encoded"] = q["search_page"]

    q["sweep_metrics"] = sweep_sql(f"""SELECT 'Baseline' AS model, strategy, CAST(dimension AS INTEGER) AS dimension,
        sources, {SWEEP_COLS} FROM sa_sweep""")
    grid = [{"dense": 1.0, "splade": 0.5, "bm25": 0.3}, {"dense": 1.0, "splade": 0.7, "bm25": 0.3},
            {"dense": 1.0, "splade": 0.5, "bm25": 0.2}]
    srcs = ("dense", "bm25", "splade")
    grid_runs = [(" ".join(f"{x}={w.get(x, 0.0):g}" for x in srcs) + f" k={k}", 64, srcs, w, k)
                 for w in grid for k in (60, 10)]
    q["fusion_grid"] = sweep_sql(f"""SELECT 'Baseline' AS model, strategy, CAST(dimension AS INTEGER) AS dimension,
        sources, {SWEEP_COLS} FROM sa_sweep""", runs=grid_runs)
    q["pairs_head"] = pairs_sql("SELECT * FROM pairs ORDER BY example_id LIMIT 5")
    q["distinct_query_ids"] = pairs_sql("SELECT DISTINCT query_id FROM pairs")
    q["exact_flag"] = pairs_sql("""SELECT example_id, max(CASE WHEN esci_label = 'E' THEN 1 ELSE 0 END)
        OVER (PARTITION BY product_locale, query_id) = 1 AS has_exact FROM f2""")
    q["encoded_dense_topk"] = pairs_sql(ranked_sel.format(src="dense", lst="dn_64_list"), dense_ctes("dn", (64,)))
    q["encoded_sparse_topk"] = q["learned_sparse_topk"]
    q["rerank_model"] = q["rerank_overlap"]
    piv = ", ".join(f"max(CASE WHEN strategy = '{n}' THEN recall_200 END) AS {n.lower().replace(' + ', '_').replace(' ', '_')}"
                    for n, _ in STRATS)
    q["sweep_pivot"] = sweep_sql(f"SELECT CAST(dimension AS INTEGER) AS dimension, {piv} FROM sa_sweep GROUP BY dimension")
    lift_cols = []
    for m in ("recall_200", "ndcg_20"):
        lift_cols += [f"a.{m} AS {m}_base", f"b.{m} AS {m}_tuned",
                      f"round((b.{m} - a.{m}) / nullif(a.{m}, 0) * 100.0{D}, 6) AS {m}_lift_pct"]
    lift = (f"SELECT a.strategy, CAST(a.dimension AS INTEGER) AS dimension, {', '.join(lift_cols)} "
            f"FROM sa_sweep a JOIN sb_sweep b ON a.strategy = b.strategy AND a.dimension = b.dimension")
    q["lift_comparison"] = sweep_sql(lift, ("a", "b"))
    lift2 = []
    for m in ("recall_200", "ndcg_20"):
        # round a 6-digit value to 2 through DECIMAL (half away from zero on
        # the decimal digits), as Spark's round does
        r2 = "CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DOUBLE)"
        lift2 += [r2.format(x=f"a.{m}") + f" AS {m}_base", r2.format(x=f"b.{m}") + f" AS {m}_tuned",
                  r2.format(x=f"round((b.{m} - a.{m}) / nullif(a.{m}, 0) * 100.0{D}, 6)") + f" AS {m}_lift_pct"]
    q["lift_at_dim"] = sweep_sql(
        f"SELECT a.strategy, CAST(a.dimension AS INTEGER) AS dimension, {', '.join(lift2)} "
        f"FROM sa_sweep a JOIN sb_sweep b ON a.strategy = b.strategy AND a.dimension = b.dimension "
        f"WHERE a.dimension = 64", ("a", "b"))
    q["safe_metric_names"] = ("SELECT conv_id, turn, regexp_replace(replace(text, '@', '_'), "
                              "'[^0-9a-zA-Z_\\-\\. /]', '_', 'g') AS safe FROM conversations")
    q["pairs_roundtrip"] = pairs_sql("SELECT example_id, query_id, product_id, product_locale, query, esci_label, "
                                     "grade, product_title, product_text_dense, split FROM tp")
    q["metrics_csv_roundtrip"] = q["sweep_metrics"]
    q["bm25_index_roundtrip"] = q["bm25_topk"]
    padded = """
SELECT query_id, '{src}' AS source, product_id, score, CAST(rn - 1 AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rn FROM (
    SELECT query_id, product_id, max(score) AS score FROM (
      SELECT query_id, product_id, score FROM {sc}
      UNION ALL SELECT query_id, product_id, 0.0::DOUBLE FROM ({ids}) i CROSS JOIN (SELECT product_id FROM uprod ORDER BY product_id LIMIT 30) p) u
    GROUP BY ALL) g) r WHERE rn <= 30"""
    q["bm25_topk_padded"] = pairs_sql(padded.format(src="bm25", sc="bm_sc", ids="SELECT DISTINCT query_id FROM bm_qtf JOIN bm_df USING (term)"), bm)
    q["learned_sparse_topk_padded"] = pairs_sql(padded.format(src="splade", sc="sp_sc", ids="SELECT DISTINCT query_id FROM sp_qw"), splade_ctes(500))
    q["bm25_min_df"] = pairs_sql("""
SELECT doc_id, term, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS dl, df
FROM bm_tf JOIN (SELECT term, df FROM bm_df WHERE df >= 2) f USING (term)""", bm)
    q["rerank_order"] = pairs_sql("""SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, product_id) - 1 AS INTEGER)
        AS position FROM rr""", rr)
    negatives = cc + f""",
neg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, product_id) - 1 AS n FROM fused f WHERE rank >= 10 AND rank < 100
        AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.query_id = f.query_id AND tp.product_id = f.product_id AND tp.grade >= 0.1{D})),
hard AS (SELECT query_id, product_id, rank, CAST(n AS INTEGER) AS negative FROM neg WHERE n < 5)"""
    q["hard_negatives"] = pairs_sql("SELECT * FROM hard", negatives)
    q["hard_negative_triples"] = pairs_sql(f"""
SELECT {_q(QUERY_INSTRUCTION)} || coalesce(u.query, 'None') AS anchor, p.product_text_dense AS positive, n.product_text_dense AS negative
FROM (SELECT DISTINCT query_id, product_id FROM tp WHERE grade >= 0.99{D}) r JOIN uprod p USING (product_id)
JOIN hard h ON h.query_id = r.query_id JOIN uprod n ON n.product_id = h.product_id JOIN uq u ON u.query_id = r.query_id""", negatives)
    q["versioned_artifacts"] = pairs_sql("SELECT example_id, query_id, split, uq.query AS query_text FROM tp JOIN uq USING (query_id)")
    q["raw_scan"] = with_fixtures("""
SELECT e.example_id, e.query_id, e.product_id, e.small_version, e.split, p.product_title, true AS no_bullets
FROM fx_examples e LEFT JOIN fx_products p ON e.product_id = p.product_id AND e.product_locale = p.product_locale
WHERE e.query_id % 7 <> 0""", "fx_examples", "fx_products")
    q["raw_scan_report"] = with_fixtures("""
SELECT * FROM (VALUES ('example_id', 'as declared'), ('query', 'as declared'), ('product_id', 'as declared'), ('product_locale', 'as declared'),
  ('esci_label', 'as declared'), ('split', 'as declared'), ('query_id', 'another type'), ('note', 'extra')) v("column", status), (SELECT 0::BIGINT AS n_bad) z
UNION ALL SELECT 'small_version', 'another type', count(*) FROM fx_examples WHERE query_id % 7 = 0""", "fx_examples")
    q["drift_sketches"] = """
SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, count(*) - count(value) AS n_missing, round(min(value), 6) AS low, round(max(value), 6) AS high,
       true AS p50_near, true AS p95_near, true AS users_near FROM events GROUP BY 1"""
    q["drift_mix"] = """
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS c FROM events GROUP BY 1, 2),
t AS (SELECT period, sum(c) AS n FROM c GROUP BY 1),
g AS (SELECT period, event_type FROM (SELECT DISTINCT period FROM c) a CROSS JOIN (SELECT DISTINCT event_type FROM c) b),
s AS (SELECT g.period, g.event_type, coalesce(c.c, 0)::DOUBLE / t.n AS p FROM g JOIN t USING (period)
      LEFT JOIN c ON c.period = g.period AND c.event_type IS NOT DISTINCT FROM g.event_type)
SELECT s.period, CAST(max(t.n) AS BIGINT) AS n, round(sum(abs(s.p - b.p)) / 2, 6) AS mix_distance
FROM s JOIN t USING (period) JOIN s b ON b.period = (SELECT min(period) FROM c) AND b.event_type IS NOT DISTINCT FROM s.event_type GROUP BY s.period"""
    q["approx_profiles"] = pairs_sql("""
SELECT 'total' AS scope, 'all' AS key, true AS near UNION ALL SELECT DISTINCT 'locale', product_locale, true FROM pairs
UNION ALL SELECT DISTINCT 'split', split, true FROM pairs
UNION ALL SELECT 'tokens', 'p' || p, true FROM (VALUES (50), (75), (90), (95), (99)) v(p)""")
    norm = f"round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6)"
    q["artifacts_roundtrip"] = pairs_sql(f"SELECT product_id AS id, 'product' AS kind, {norm} AS norm FROM av_pv UNION ALL "
                                         f"SELECT CAST(query_id AS VARCHAR), 'query', {norm} FROM av_qv",
                                         dense_ctes("av", ()).replace("FROM gq)", "FROM uq)"))
    told = [("split", "'test'"), ("rrf_k", "'60'"), ("candidate_top_k", "'200'"), ("dense_top_k", "'500'"), ("sparse_top_k", "'500'"),
            ("w_dense", "'1.0'"), ("w_bm25", "'0.3'"), ("w_splade", "'0.5'"), ("strategy", "strategy"), ("dimension", "CAST(dimension AS VARCHAR)")]
    run = "'candidates__' || strategy || '__' || CAST(dimension AS VARCHAR)"
    q["run_log"] = sweep_sql(" UNION ALL ".join(
        [f"SELECT {run} AS run_name, '{k}' AS entry, {v} AS told, -1.0{D} AS number FROM sa_sweep" for k, v in told]
        + [f"SELECT {run}, '{m}', '-', {m} FROM sa_sweep" for m in SWEEP_COLS.split(", ")]))
    q["bm25_index_roundtrip_unstemmed"] = q["bm25_topk_unstemmed"]
    q["sparse_index_roundtrip"] = q["learned_sparse_topk"]
    return q
