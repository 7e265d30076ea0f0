"""SQL of the text queries that SQL can say over whole tables.

The others need a tokenizer, a lexer, an alignment or a flow; they are tested against brute force on small tables.
"""

from __future__ import annotations

_RUN = """w AS (SELECT doc_id, i, hash(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
 r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM r))"""

_STEPS = (
    (r"(?s)<!--.*?(?:-->|$)", ""),
    (r"(?si)<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>?", ""),
    (r"</?[a-zA-Z][^<>]*>", ""),
    (r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1"),
    (r"(?i)\[(?:https?|ftp|mailto):[^\s\]]*\s*([^\]]*)\]", r"\1"),
    (r"''{2,5}", ""),
)


def _words() -> str:
    """The words of ``text`` as a reader sees it, as far as SQL's patterns go."""
    out = "coalesce(text, '')"
    for rx, put in _STEPS:
        out = f"regexp_replace({out}, '{rx}', '{put}', 'g')"
    for entity, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{put}')"
    return rf"regexp_extract_all(lower({out}), '[\p{{L}}\p{{N}}]+')"


SQL: dict[str, str] = {
    "p6_found": f"""WITH d AS (SELECT doc_id, {_words()} AS w FROM documents), t AS (SELECT item_id, {_words()} AS w FROM eval_items),
 g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM t)),
 c AS (SELECT doc_id, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d)) SELECT DISTINCT item_id, doc_id FROM g JOIN c ON c.g = g.g""",
    "p8_found": f"WITH {_RUN} SELECT DISTINCT doc_id FROM m",
    "p8_coverage": f"""WITH {_RUN}, n AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS pv FROM m),
 c AS (SELECT doc_id, sum(least(400, coalesce(nx - i, 400)))::BIGINT AS shared, count(*) FILTER (WHERE pv IS NULL OR i - pv > 400)::BIGINT AS spans FROM n GROUP BY doc_id)
 SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(c.shared, 0)::BIGINT AS shared_chars, coalesce(c.spans, 0)::BIGINT AS n_spans, round(coalesce(c.shared, 0)::DOUBLE / greatest(1, coalesce(length(d.text), 0)), 6)::DOUBLE AS share
 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
    # which sources fall short is the same for any tokenizer, so words and signs do
    "p7_found": r"""WITH d AS (SELECT lower(trim(source)) AS s, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS n FROM documents)
 SELECT source FROM mix_targets m WHERE coalesce((SELECT sum(n) FROM d WHERE d.s = lower(trim(m.source))), 0) * m.max_repeat < m.weight * (SELECT sum(n) FROM d)""",
}
