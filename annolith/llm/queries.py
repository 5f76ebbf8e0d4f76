"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from importlib import import_module

from .common import documents

#: query: (module, function) applied to the documents table
_ON_DOCUMENTS = {
    "op2_quality_rules": ("quality_rules", "quality_rules"),
    "op3_token_counts": ("token_counts", "token_counts"),
    "op5_exact_dedup": ("exact_dedup", "exact_dedup"),
    "op6_token_id_output": ("binary_output", "token_id_output"),
    "op7_packing": ("packing", "pack"),
    "op8_language_id": ("language_id", "language_id"),
    "op9_source_mixing": ("mixing", "mixture"),
    "op10_license_scan": ("license_scan", "license_scan"),
    "op11_periodic_runs": ("runs", "periodic_runs"),
    "op13_cross_tokenizer_alignment": ("alignment", "cross_tokenizer_alignment"),
}


def _query(module: str, function: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), function)(spark, documents(spark, sf_dir))

    return run


def _quality_classifier(spark, sf_dir):
    from .quality_classifier import quality_scores

    return quality_scores(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _ngram_join(spark, sf_dir):
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(spark, documents(spark, sf_dir), width=4, percent=85)


def _warc(spark, sf_dir):
    from .warc import archived_pages

    return archived_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict:
    others = {"op1_ngram_jaccard_join": _ngram_join, "op4_quality_classifier": _quality_classifier, "op12_warc": _warc}
    return others | {name: _query(*where) for name, where in _ON_DOCUMENTS.items()}


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = r"""with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
 w as (select k, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] as w from d),
 i as (select k, unnest(range(1, len(w) - 3)) as i, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as g from w),
 v as (select k, i, count(*) over (partition by k, g) as n from i),
 r as (select k, count(distinct p) as n_repeat_words from (select k, unnest(range(i, i + 5)) as p from v where n > 1) q group by 1),
 l as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select k, unnest(string_split(text, chr(10))) as line from d) q where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
 f as (select d.doc_id, d.text, len(w.w) as n_words, coalesce(length(array_to_string(w.w, '')), 0) as word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(l.n_dup_lines, 0) as n_dup_lines, coalesce(l.n_lines, 0) as n_lines, coalesce(r.n_repeat_words, 0) as n_repeat_words from d join w using (k) left join l using (k) left join r using (k)),
 b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 100 * n_symbols > 25 * n_words or word_chars < 2 * n_words or word_chars > 14 * n_words or (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)
  or 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars or 10 * ((length(text) - length(replace(text, '!!', ''))) // 2) > n_words or 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars) as kept from b"""


_LINKS = rf"""with recursive w as (select doc_id, [x for x in string_split_regex({_NORMAL}, '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
 n as (select doc_id, count(*) as n from s group by 1), p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)), both_ways as (select a, b from l union select b, a from l),
 reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, t.b from reach r join both_ways t on t.a = r.other), c as (select doc_id, min(other) as component_id from reach group by 1)
 select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id from documents d left join n using (doc_id) left join c using (doc_id)"""


#: crc32 by its table; equal stretches of six words are joined by their distance, and islands of places are runs.
_RUNS = r"""with recursive bits(n, c, k) as (select i, i, 0 from range(256) q(i) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
 crc as (select list(c order by n) as t from bits where k = 8),
 d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]) as b from documents),
 h as (select k, doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::int])), 4294967295) as h, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] as w from d, crc),
 g as (select k, doc_id, h % 10 = 0 and len(w) > 0 as changed, len(w)::bigint as n, (h // 10) % greatest(len(w), 1) as a, 3 + (h // 10) % 8 as m, w from h),
 w as (select k, doc_id, n, case when changed then [w[case when i >= a then a + (i - a) % (1 + (n - a) // m) else i end + 1] for i in range(0, n)] else w end as w from g),
 e as (select k, unnest(range(0, n)) as i, unnest([array_to_string(w[i + 1:i + 6], ' ') for i in range(0, n)]) as g from w),
 p as (select x.k, x.i, y.i - x.i as q from e x join e y on x.k = y.k and x.g = y.g and x.i < y.i),
 f as (select k, q, i, i - row_number() over (partition by k, q order by i) as island from p),
 s as (select k, q, min(i) as start, count(*) + 5 + q as length from f group by k, q, island),
 r as (select k, start, length, min(q) as period from s where length >= greatest(12, 2 * q) group by all),
 a as (select k, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines, arg_min({'s': start, 'l': length, 'p': period}, (-length, start, period)) as top from r group by k),
 x as (select k, list_distinct(list(i)) as gone from (select k, unnest(range(start + period, start + length)) as i from r) q group by k),
 y as (select w.k, string_agg(w, ' ' order by i) as kept from (select k, unnest(w) as w, unnest(range(0, n)) as i from w) w left join (select k, unnest(gone) as i, true as hit from x) x using (k, i) where hit is null group by w.k)
 select doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.p as period, 1000 * top.l // top.p as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from w left join a using (k) left join y using (k)"""


_DIGITS = "list_value(" + ", ".join(f"'{c}'" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + ")"
#: Five hexadecimal digits are four of base 32.
_WARC = f"""with d as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, sha256(coalesce(html, '')) as s from pages), k as (select *, max(page_id) over (partition by s) as keep from d),
 p as (select *, [('0x' || h[5 * i + 1:5 * i + 5])::int for i in range(0, 8)] as v from k)
 select page_id, n as payload_bytes, array_to_string([array_to_string([{_DIGITS}[((x >> (15 - 5 * j)) & 31) + 1] for j in range(0, 4)], '') for x in v], '') as payload_digest,
  case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to from p"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: not tokenisation, trained models, aligned templates or dealt copies."""
    return {
        "op1_ngram_jaccard_join": _LINKS,
        "op2_quality_rules": _RULES,
        "op11_periodic_runs": _RUNS,
        "op12_warc": _WARC,
        "op5_exact_dedup": f"select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256 from (select doc_id, {_NORMAL} as norm from documents) q window w as (partition by norm)",
    }
