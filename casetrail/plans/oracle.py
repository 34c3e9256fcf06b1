"""The oracle's SQL for the core queries, in DuckDB's dialect."""

from __future__ import annotations

from casetrail.functions import extraction as X
from casetrail.functions.extraction import SIGNALS
from casetrail.functions.figures import CLASS_PATTERNS
from casetrail.functions.keys import ARTICLE_KEY_SQL

KEY = ARTICLE_KEY_SQL.format("pubmed_id")
_SIGNAL = f"coalesce(regexp_matches(abstract, '(?i){'|'.join(SIGNALS)}'), false)"
_W = r"[\pL\pN\pM_]"


def _unicode(pattern: str) -> str:
    """A class pattern with boundaries in the Unicode sense, which the oracle's engine lacks."""
    inner = pattern.replace(r"\b(?:", "(?:", 1).replace(r"\b(", "(?:", 1).removesuffix(r"\b").replace(r"\w*", _W + "*").replace(r"|×\s?\d", "")
    return f"(?i)(?:^|[^\\pL\\pN\\pM_]){inner}(?:$|[^\\pL\\pN\\pM_])" + (rf"|{_W}×\s?\d(?:$|[^\pL\pN\pM_])" if "×" in pattern else "")


_CLASS = " ".join(f"WHEN regexp_matches(caption, '{_unicode(p)}') THEN '{n}'" for n, p in CLASS_PATTERNS)
_TOPIC = {"kidney": "nephr|renal|urine", "skin": "rash|skin|purpura", "lung": "lung|pleur|cough", "nerve": "seizure|neur|headache"}
_REFS = f"""
  SELECT 'extracted_figures' AS table_name, figure_id AS row_id, {KEY} AS k, loaded_at FROM extracted_figures
  UNION ALL SELECT 'sle_labels', label_id, {KEY}, loaded_at FROM sle_labels"""
_LIFE = f"""
  SELECT k, min(loaded_at) AS first_loaded, min(withdrawn_at) AS gone FROM (
    SELECT {KEY} AS k, loaded_at, NULL::TIMESTAMP AS withdrawn_at FROM case_reports
    UNION ALL SELECT {KEY}, NULL, withdrawn_at FROM withdrawals) WHERE k IS NOT NULL GROUP BY k"""
_ORPHANS = f"""
  SELECT r.* FROM ({_REFS}) r LEFT JOIN ({_LIFE}) p ON r.k = p.k
  WHERE r.k IS NOT NULL AND (p.first_loaded IS NULL OR r.loaded_at < p.first_loaded OR r.loaded_at >= p.gone
    OR (r.loaded_at IS NULL AND p.gone IS NOT NULL))"""
_BM = """
 WITH w AS (SELECT report_id, list_filter(regexp_split_to_array(lower(coalesce(abstract, '')), '[^\\pL\\p{Nd}\\p{Nl}\\pM\\p{Pc}\\x{200C}\\x{200D}]+'), lambda x: x <> '') AS l FROM case_reports),
 t AS (SELECT report_id, len(l) AS n, len(list_filter(l, lambda x: x = 'tuberculosis')) AS a, len(list_filter(l, lambda x: x = 'lymphoma')) AS b,
       len(list_filter(l, lambda x: x = 'seizures')) AS c FROM w),
 s AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM t)"""


def _bm(tf: str, df: str) -> str:
    return f"ln((d - {df} + 0.5) / ({df} + 0.5) + 1.0) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * n / m))"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


_COSINE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"

_DELAYS = [f"try_cast(nullif(regexp_extract(plain, '{p}', 1), '') AS BIGINT) * CASE lower(regexp_extract(plain, '{p}', 2)) "
           "WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END" for p in X.DELAYS]

# The tier cascade in the oracle's dialect: no lookahead, so what ends an entity is consumed, and no Unicode classes by default.
_C = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
_S = r"[\s\x0b\x{85}\pZ]"


def _re(pattern: str) -> str:
    """A fixed pattern with letters and blanks in the Unicode sense, quoted for SQL."""
    inside = pattern.replace(r"[\w][\w\s'\-]", rf"[{_C}][{_C}\s\x0b\x{{85}}\pZ'\-]").replace(r"[\w'\-]", rf"[{_C}'\-]").replace(r"\w*", rf"[{_C}]*").replace(r"\s+", _S + "+")
    return "(?i)" + inside.replace("'", "''")


def _words(words: tuple[str, ...]) -> str:
    return "|".join(words)


_STOP = rf"(?:[,;.!?(]|\s+(?:{_words(X.STOP_WORDS)})\b|$)"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


_FILLER = f"(?i)(?:{_S}*\\b(?:{_words(X.FILLER_WORDS)})\\b{_S}*){{1,5}}$"


def _tier_sql(patterns: list[str]) -> str:
    """Entities of a tier, in order of pattern and place, each once."""
    raw = " || ".join(f"regexp_extract_all(abstract, '{_re(p)}', 1)" for p in patterns)
    bare = _strip(f"regexp_replace({_strip('x')}, '{_FILLER}', '')")
    known = f"""list_filter(list_transform({raw}, lambda x: {bare}), lambda e: len(e) BETWEEN 4 AND 80
        AND NOT regexp_matches(e, '(?i)^(?:{_words(X.NOISE_STARTS)})(?:[^{_C}]|$)') AND NOT regexp_matches(e, '(?i)(?:^|[^{_C}])(?:{_words(X.PERSON_WORDS)})(?:[^{_C}]|$)'))"""
    return f"list_filter(list_transform({known}, lambda e: trim(lower(e), ' .,;-')), lambda e: e <> '')"


def _once(entities: str) -> str:
    """Without the target diseases, and each once."""
    return f"""list_filter({entities}, lambda e: NOT (regexp_matches(e, '(?i)(?:^|[^{_C}])(?:{_words(X.TARGET_TERMS)})(?:[^{_C}]|$)') OR coalesce(
        regexp_matches(e, CASE WHEN disease = '' THEN '\\b' ELSE '(?i)(?:^|[^{_C}])' || regexp_escape(replace(lower(disease), '_', ' ')) || '(?:[^{_C}]|$)' END), false)))"""


_TERMS = "[" + ", ".join("'" + t.lower().replace("'", "''") + "'" for t in X.LEXICON) + "]"
_HITS = f"""flatten(list_transform(list_filter(string_split(regexp_replace(abstract, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '(?i){'|'.join(SIGNALS)}')),
        lambda s: list_filter({_TERMS}, lambda t: regexp_matches(s, '(?i)(?:^|[^{_C}])' || regexp_escape(t) || '(?:[^{_C}]|$)'))))"""
_HIGH = _tier_sql([t + X.ENTITY + _STOP for t in X.HIGH_TRIGGERS] + [X.PASSIVE, X.MASQUERADE])
_MEDIUM = _tier_sql([t + X.ENTITY + _STOP for t in X.MEDIUM_TRIGGERS])
_FIRST = "list_filter({0}, lambda e, i: list_position({0}, e) = i)"
_EXTRACTED = f"""
    WITH r AS (SELECT report_id, disease, abstract, misdiagnosis_sequence FROM case_reports WHERE len(coalesce(abstract, '')) >= {X.SHORTEST_TEXT}),
    f AS (SELECT *, {_once(_HIGH)} AS high, {_once(_MEDIUM)} AS medium, regexp_matches(abstract, '(?i){'|'.join(SIGNALS)}') AS signal,
          CASE WHEN signal THEN {_once(_HITS)} ELSE [] END AS lexicon FROM r),
    l AS (SELECT *, CASE WHEN len(high) > 0 THEN 'high' WHEN len(medium) > 0 THEN 'medium' WHEN NOT signal THEN 'none' WHEN len(lexicon) > 0 THEN 'gazetteer' ELSE 'signal_only' END AS level FROM f),
    e AS (SELECT report_id, misdiagnosis_sequence, level, CASE level WHEN 'high' THEN {_FIRST.format('high')} WHEN 'medium' THEN {_FIRST.format('medium')}
                 WHEN 'gazetteer' THEN {_FIRST.format('lexicon')} ELSE [] END AS found FROM l)
    SELECT report_id, level AS evidence_level, CASE WHEN len(found) > 0 THEN found ELSE misdiagnosis_sequence END AS sequence FROM e
    UNION ALL SELECT report_id, 'no_abstract', misdiagnosis_sequence FROM case_reports WHERE len(coalesce(abstract, '')) < {X.SHORTEST_TEXT}"""

ORACLE = {
    "signal_by_disease": f"""
        SELECT disease, is_total, n, n_flagged, n_flagged::DOUBLE / n AS share FROM (
          SELECT disease, grouping(disease)::INTEGER AS is_total, count(*) AS n, count(*) FILTER ({_SIGNAL}) AS n_flagged
          FROM case_reports GROUP BY ROLLUP (disease))""",
    "diagnostic_delays": f"""
        SELECT report_id, delay_days FROM (SELECT report_id, coalesce({', '.join(_DELAYS)}) AS delay_days
          FROM (SELECT report_id, regexp_replace(abstract, '{X.AGES}', ' ', 'g') AS plain FROM case_reports)) WHERE delay_days IS NOT NULL""",
    "extract_levels": f"SELECT report_id, evidence_level, array_to_string(sequence, ' | ') AS sequence FROM ({_EXTRACTED})",
    "signal_only_reports": f"SELECT report_id FROM ({_EXTRACTED}) WHERE evidence_level = 'signal_only'",
    "extract_summary": f"""
        SELECT *, n_high + n_medium + n_gazetteer AS populated, coalesce(100 * (n_none::DOUBLE / nullif(total::DOUBLE, 0)), 0.0) AS no_signal_pct
        FROM (SELECT count(*) AS total, {', '.join(f"count(*) FILTER (evidence_level = '{b}') AS n_{b}" for b in ('high', 'medium', 'gazetteer', 'signal_only', 'none', 'no_abstract'))}
              FROM ({_EXTRACTED}))""",
    "caption_classes": f"SELECT figure_id, CASE {_CLASS} ELSE 'other' END AS class FROM extracted_figures",
    "figures_by_type": """
        SELECT disease, type, grouping_id(disease, type)::INTEGER AS level, count(*) AS n
        FROM (SELECT coalesce(disease, '') AS disease, lower(coalesce(figure_type, 'other')) AS type FROM extracted_figures)
        GROUP BY ROLLUP (disease, type)""",
    "last_reports": f"""
        SELECT {KEY} AS article, report_id, batch_no, disease FROM case_reports WHERE {KEY} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY report_id DESC) = 1""",
    "merged_summary": f"""
        WITH c AS (SELECT {KEY} AS article, disease FROM case_reports WHERE {KEY} IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY report_id DESC) = 1),
        f AS (SELECT {KEY} AS article, count(*)::INTEGER AS n, first(figure_id ORDER BY figure_index NULLS FIRST, figure_id) AS first_figure,
                     first(disease ORDER BY figure_index NULLS FIRST, figure_id) AS disease
              FROM extracted_figures WHERE {KEY} IS NOT NULL GROUP BY 1)
        SELECT coalesce(c.article, f.article) AS article, coalesce(CASE WHEN c.article IS NOT NULL THEN c.disease ELSE f.disease END, '') AS disease,
               c.article IS NOT NULL AS has_case_report, coalesce(f.n, 0)::INTEGER AS n_figures, coalesce(f.first_figure, -1) AS first_figure
        FROM c FULL JOIN f ON c.article = f.article""",
    "label_confusion": f"""
        WITH p AS (SELECT {KEY} AS article, coalesce(len(misdiagnosis_sequence), 0) > 0 AS predicted FROM case_reports WHERE {KEY} IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY report_id DESC) = 1),
        t AS (SELECT {KEY} AS article, has_misdiagnosis = 1 AS truth FROM sle_labels WHERE {KEY} IS NOT NULL AND has_misdiagnosis IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY label_id DESC) = 1),
        m AS (SELECT count(*) FILTER (predicted AND truth) AS tp, count(*) FILTER (predicted AND NOT truth) AS fp,
                     count(*) FILTER (NOT predicted AND truth) AS fn, count(*) FILTER (NOT predicted AND NOT truth) AS tn FROM p JOIN t USING (article)),
        r AS (SELECT *, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall FROM m)
        SELECT *, {_ratio('2 * precision * recall', 'precision + recall')} AS f1, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
               {_ratio('greatest(tp + fn, fp + tn)', 'tp + fp + fn + tn')} AS baseline FROM r""",
    "wrong_diagnosis_edges": """
        SELECT wrong, disease, count(*) AS weight FROM (SELECT unnest(misdiagnosis_sequence) AS wrong, disease FROM case_reports)
        WHERE wrong IS NOT NULL GROUP BY ALL""",
    "diagnosis_trails": "SELECT report_id, array_to_string(misdiagnosis_sequence, ' → ') AS trail FROM case_reports WHERE len(misdiagnosis_sequence) > 0",
    "sequence_items": """
        SELECT report_id, (unnest(range(len(misdiagnosis_sequence))))::INTEGER AS place, unnest(misdiagnosis_sequence) AS item FROM case_reports""",
    "topics_by_disease": " UNION ALL ".join(
        f"SELECT '{t}' AS topic, coalesce(disease, '') AS disease, count(*) AS n FROM case_reports WHERE regexp_matches(abstract, '(?i){p}') GROUP BY ALL"
        for t, p in _TOPIC.items()),
    "file_ids": r"""
        SELECT figure_id, file, CASE WHEN digits = '' THEN stem ELSE digits END AS stem_id FROM (
          SELECT figure_id, file, stem, regexp_replace(stem, '[^0-9]', '', 'g') AS digits FROM (
            SELECT figure_id, file, regexp_replace(file, '(.)\.[^.]*$', '\1') AS stem FROM (
              SELECT figure_id, list_last(string_split(file_path, '/')) AS file FROM extracted_figures)))""",
    "newest_versions": """
        SELECT k, 'P' || k || CASE WHEN m = 1 THEN '/' ELSE '.' || (m * 2) || '/' END AS prefix, (CASE WHEN m = 1 THEN -1 ELSE m * 2 END)::BIGINT AS version
        FROM (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1)""",
    "annotated_figures": """
        SELECT figure_id, CASE WHEN coalesce(t, 'unlabeled') = 'unlabeled' AND figure_id % 3 = 0 THEN 'histology' ELSE t END AS figure_type
        FROM (SELECT figure_id, CASE WHEN figure_index % 2 = 0 THEN 'unlabeled' ELSE figure_type END AS t FROM extracted_figures)
        WHERE NOT (coalesce(t, 'unlabeled') = 'unlabeled' AND figure_id % 7 = 0)""",
    "unlabelled_reports": f"""
        SELECT report_id, {KEY} AS article FROM case_reports WHERE {KEY} IS NOT NULL
        AND {KEY} NOT IN (SELECT {KEY} FROM sle_labels WHERE {KEY} IS NOT NULL)""",
    "zero_shot_types": f"""
        WITH q AS (SELECT vec_id AS c, embedding AS v FROM embeddings WHERE vec_id < 4),
        s AS (SELECT e.vec_id, e.label AS l, c, 100 * {_COSINE.format(a='e.embedding', b='q.v')} / (sqrt({_COSINE.format(a='e.embedding', b='e.embedding')})
              * sqrt({_COSINE.format(a='q.v', b='q.v')})) AS x FROM embeddings e, q),
        m AS (SELECT vec_id, l, max(x) AS top, arg_min(c, -x) AS c FROM s GROUP BY ALL),
        p AS (SELECT m.vec_id, any_value(m.l) AS l, any_value(m.c) AS c, 1 / sum(exp(x - top)) AS p FROM m JOIN s USING (vec_id) GROUP BY 1),
        n AS (SELECT *, ['imaging', 'histology', 'lab_chart', 'rash_image'][c + 1] AS label, CASE WHEN l < 5 THEN 'other' ELSE 'imaging' END AS t FROM p)
        SELECT vec_id, label, round(p, 6) AS p, CASE WHEN t = 'other' AND p >= 0.5 THEN label ELSE t END AS accepted FROM n""",
    "nearest_vectors": f"""
        SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {_COSINE.format(a='e.embedding', b='q.v')} / (sqrt({_COSINE.format(a='e.embedding', b='e.embedding')})
          * sqrt({_COSINE.format(a='q.v', b='q.v')})) AS s FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q)
        ORDER BY s DESC, vec_id LIMIT 10""",
    "keyword_search": f"""{_BM} SELECT report_id, round({_bm('a', 'da')} + {_bm('b', 'db')} + {_bm('c', 'dc')}, 6) AS score FROM t, s WHERE a + b + c > 0""",
    "keyword_fusion": f"""
        WITH x AS (SELECT report_id, list_filter(regexp_split_to_array(lower(coalesce(abstract, '')), '[^\\pL\\p{{Nd}}\\p{{Nl}}\\pM\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+'), lambda x: x <> '') AS l FROM case_reports),
        t AS (SELECT report_id, len(l) AS n, {', '.join(f"len(list_filter(l, lambda x: x = '{w}')) AS {c}" for w, c in (('tuberculosis', 'a'), ('lymphoma', 'b'), ('seizures', 'c'), ('rash', 'e')))} FROM x),
        s AS (SELECT count(*) AS d, avg(n) AS m, {', '.join(f'count(*) FILTER ({c} > 0) AS d{c}' for c in 'abce')} FROM t),
        one AS (SELECT report_id, round({_bm('a', 'da')} + {_bm('b', 'db')}, 6) AS score FROM t, s WHERE a + b > 0),
        two AS (SELECT report_id, round({_bm('c', 'dc')} + {_bm('e', 'de')}, 6) AS score FROM t, s WHERE c + e > 0),
        r AS (SELECT report_id, row_number() OVER (ORDER BY score DESC, report_id) AS k FROM one UNION ALL SELECT report_id, row_number() OVER (ORDER BY score DESC, report_id) FROM two)
        SELECT report_id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS score FROM r WHERE k <= 100 GROUP BY 1""",
    "topic_table": f"""SELECT coalesce(disease, '') AS disease, {', '.join(f"count(*) FILTER (regexp_matches(abstract, '(?i){p}')) AS {t}" for t, p in _TOPIC.items())} FROM case_reports GROUP BY 1""",
    "figure_totals": f"""
        SELECT count(DISTINCT {KEY}) AS articles, count(*) AS figures, count(file_path) AS saved, count(*) FILTER (lower(figure_type) = 'other') AS unclassified FROM extracted_figures""",
    "diagnosis_directions": """
        SELECT CASE WHEN coalesce(len(list_filter(misdiagnosis_sequence, lambda e: lower(e) = lower(disease))), 0) > 0 THEN 'reverse'
          WHEN coalesce(len(misdiagnosis_sequence), 0) > 0 THEN 'forward' ELSE 'none' END AS direction, count(*) AS n FROM case_reports GROUP BY 1""",
    "figure_diseases": f"""
        SELECT figure_id, coalesce(d, '') AS report_disease FROM extracted_figures f LEFT JOIN (SELECT {KEY} AS k, coalesce(disease, '') AS d FROM case_reports WHERE {KEY} IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY report_id DESC) = 1) r ON {ARTICLE_KEY_SQL.format('f.pubmed_id')} = r.k""",
    "reported_figures": f"""
        SELECT figure_id, report_id FROM extracted_figures f JOIN (SELECT {KEY} AS k, max(report_id) AS report_id FROM case_reports WHERE {KEY} IS NOT NULL GROUP BY 1) r
        ON {ARTICLE_KEY_SQL.format('f.pubmed_id')} = r.k""",
    "nearest_captions": """
        SELECT figure_id, CASE WHEN figure_index % 9 * 10 >= 35 AND figure_index % 9 * 10 <= 60 AND lower(caption) LIKE 'fig%' AND (figure_index % 9 * 10 < 60 OR caption < 'Figure ' || figure_index)
          THEN replace(caption, chr(10), ' ') ELSE 'Figure ' || figure_index END AS caption FROM extracted_figures WHERE figure_index IS NOT NULL""",
    "term_forms": r"""
        SELECT map_id, regexp_replace(regexp_replace(hpo_term, '^[\s\x0b\x{85}\pZ]+', ''), '[\s\x0b\x{85}\pZ]+$', '') AS trimmed,
          regexp_replace(string_split(regexp_replace(hpo_term || chr(10) || 'second', '^[\s\x0b\x{85}\pZ]+', ''), chr(10))[1], '', '') AS line,
          replace(url_encode(hpo_id), '%2F', '/') AS address, printf('%.2f', map_id / 8.0) AS number, hpo_term[1:12] AS start
        FROM hpo_mapping_table WHERE hpo_term IS NOT NULL""".replace("\\\\", "\\"),
    "first_reports": f"SELECT report_id, {KEY} AS article FROM case_reports WHERE {KEY} IS NOT NULL ORDER BY report_id LIMIT 10",
    "unreadable_props": """
        SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN left(props, len(props) - 1) ELSE props END AS v FROM events) WHERE NOT json_valid(v) AND NOT regexp_full_match(v, '\\s*')""",
    "phenotype_map": """
        SELECT map_id, disease, term_id, phenotype_category FROM hpo_mapping_table JOIN hpo_terms ON hpo_term = term_name""",
    "invalid_records": f"""
        SELECT report_id, concat_ws(',', {', '.join(f"CASE WHEN {f} IS NULL THEN '{f}:null' END" for f in ('pubmed_id', 'disease', 'title', 'abstract'))},
          CASE WHEN misdiagnosis_sequence IS NULL THEN 'misdiagnosis_sequence:null'
               WHEN len(misdiagnosis_sequence) > 0 AND len(list_filter(misdiagnosis_sequence, lambda x: x IS NULL)) = len(misdiagnosis_sequence) THEN 'misdiagnosis_sequence:wrong_type' END,
          CASE WHEN extracted_at IS NULL THEN 'extracted_at:null' END) AS errors
        FROM case_reports""",
    "p5_found": f"SELECT table_name, row_id FROM ({_ORPHANS})",
    "p5_counts": f"""
        SELECT table_name, coalesce(strftime(loaded_at, '%Y-%m'), 'unknown') AS month, count(*) AS n_orphans FROM ({_ORPHANS}) GROUP BY ALL""",
}
