"""The stemmer of `functions.stem` as SQL, for the statements of the retrieval queries."""

from __future__ import annotations

from quillspark.functions.stem import STEP2, STEP3, STEP4

_FORM = "regexp_replace(translate(w, 'aeiou', '11111'), '[^1y]', '0', 'g')"


def _form() -> str:
    """Vowels as 1, consonants as 0: y is a vowel behind a consonant."""
    f = f"regexp_replace({_FORM}, '^y', '0')"
    for _ in range(4):
        f = f"replace(replace({f}, '0y', '01'), '1y', '10')"
    return f


def _cvc(n: str = "length(w)") -> str:
    return f"(left(f, {n}) LIKE '%010' AND substr(w, {n}, 1) NOT IN ('w', 'x', 'y'))"


def _table(table: dict[str, str]) -> str:
    rows = "".join(f" WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches(left(f, length(w) - {len(s)}), '1+0+') THEN left(w, length(w) - {len(s)}) || '{t}' ELSE w END" for s, t in sorted(table.items(), key=lambda x: -len(x[0])))
    return f"CASE{rows} ELSE w END"


def porter_ctes(vocabulary: str) -> str:
    """CTEs that end in stems(term, stem) of the distinct column `term` of the given query."""
    step4 = "".join(
        f" WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches(left(f, length(w) - {len(s)}), '1+0+1+0+'){extra} THEN left(w, length(w) - {len(s)}) ELSE w END"
        for s, extra in sorted([(s, "") for s in STEP4] + [("ion", " AND substr(w, length(w) - 3, 1) IN ('s', 't')")], key=lambda x: -len(x[0]))
    )
    f = _form()
    return f"""vb AS (SELECT DISTINCT term FROM ({vocabulary})),
w0 AS (SELECT term, CASE WHEN ends_with(term, 'sses') OR ends_with(term, 'ies') THEN left(term, length(term) - 2) WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN left(term, length(term) - 1) ELSE term END AS w FROM vb WHERE regexp_full_match(term, '[a-z]{{3,}}')),
w1 AS (SELECT term, w, {f} AS f FROM w0),
w2 AS (SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(f, length(w) - 3), '1+0+') THEN left(w, length(w) - 1) ELSE w END WHEN ends_with(w, 'ed') AND contains(left(f, length(w) - 2), '1') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ing') AND contains(left(f, length(w) - 3), '1') THEN left(w, length(w) - 3) ELSE w END AS w,
  NOT ends_with(w, 'eed') AND (ends_with(w, 'ed') AND contains(left(f, length(w) - 2), '1') OR ends_with(w, 'ing') AND contains(left(f, length(w) - 3), '1')) AS cut FROM w1),
w3 AS (SELECT term, w, cut, {f} AS f FROM w2),
w4 AS (SELECT term, CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') OR (regexp_full_match(f, '0*1+0+1*') AND {_cvc()}) THEN w || 'e'
  WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') AND right(f, 1) = '0' THEN left(w, length(w) - 1) ELSE w END AS w FROM w3),
w5 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND contains(left(f, length(w) - 1), '1') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM (SELECT term, w, {f} AS f FROM w4)),
w6 AS (SELECT term, {_table(STEP2)} AS w FROM (SELECT term, w, {f} AS f FROM w5)),
w7 AS (SELECT term, {_table(STEP3)} AS w FROM (SELECT term, w, {f} AS f FROM w6)),
w8 AS (SELECT term, CASE{step4} ELSE w END AS w FROM (SELECT term, w, {f} AS f FROM w7)),
w9 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(f, length(w) - 1), '1+0+1+0+') OR (regexp_full_match(left(f, length(w) - 1), '0*1+0+1*') AND NOT {_cvc('length(w) - 1')})) THEN left(w, length(w) - 1) ELSE w END AS w FROM (SELECT term, w, {f} AS f FROM w8)),
wx AS (SELECT term, CASE WHEN ends_with(w, 'll') AND regexp_matches(left(f, length(w) - 1), '1+0+1+0+') THEN left(w, length(w) - 1) ELSE w END AS w FROM (SELECT term, w, {f} AS f FROM w9)),
stems AS (SELECT vb.term, coalesce(wx.w, vb.term) AS stem FROM vb LEFT JOIN wx USING (term))"""
