"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, exact_dedup, grouping, license_scan, mixing, packing, pseudonyms, quality, repair, simhash, spotsigs, suffix_dedup, url_filter
from .common import table


#: The registered query's key; a user passes one of their own, from where they keep secrets.
PSEUDONYM_KEY = "public-test-key"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pieces(table(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filter,
    op2_exact_dedup,
    op3_pseudonyms,
    op4_spotsigs,
    op5_power_of_two_packing,
    op6_suffix_dedup,
    op7_quality_classifier,
    op8_license_scan,
    op9_simhash_near_dedup,
    op10_source_mixing,
    op11_source_divergence,
    op12_conversation_repair,
    op13_best_fit_packing,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The other results need hashes, tokens or trained models that SQL doesn't have; their
#: tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        with d as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') body from documents
        ), g as (
            select doc_id, body, sha256(body) sha, min(doc_id) over w keep_id, count(*) over w group_size,
                row_number() over (partition by body order by doc_id nulls last) = 1 kept
            from d window w as (partition by body)
        ), k as (
            select distinct ('0x' || substr(sha, 1, 15))::bigint key from g
        ), size as (  -- the first depth, and the last one
            select (case when count(*) < 4096 then 0 else greatest(0, floor(log2(count(*) // 4096))::int - 1) end)::int first from k
        ), p as (
            select depth, key >> (60 - depth) prefix, count(*) n from k, size, range(first, first + 7) r(depth) group by all
        ), b as (
            select key, min(p.depth)::int depth from k join p on p.prefix = key >> (60 - p.depth), size where n <= 4096 or p.depth = first + 6 group by key
        )
        select doc_id, keep_id, group_size, kept, sha text_sha256, ((key >> (60 - depth)) << (first + 6 - depth))::bigint bucket,
            (dense_rank() over (partition by key order by keep_id nulls last) - 1)::int chain
        from g join b on key = ('0x' || substr(sha, 1, 15))::bigint, size
    """,
    "op6_suffix_dedup": r"""
        with d as (
            select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents
        ), w as (
            select doc_id, i, substr(h, 2 * i + 1, 100) s from d, range(0, greatest(n - 49, 0)) r(i)
        ), f as (
            select s, min(doc_id) first from w group by s having count(*) > 1
        ), gone as (
            select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 50, -1) starts from w join f using (s) where first < doc_id
        ), run as (
            select doc_id, k, min(i) a, max(i) + 50 b from (select doc_id, i, sum(starts::int) over (partition by doc_id order by i) k from gone) group by doc_id, k
        ), piece as (
            select run.doc_id, a, b, substr(h, 2 * coalesce(lag(b) over o, 0) + 1, 2 * (a - coalesce(lag(b) over o, 0))) kept
            from run join d using (doc_id) window o as (partition by run.doc_id order by a)
        ), cut as (
            select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, max(b) last, string_agg(kept, '' order by a) kept from piece group by doc_id
        )
        select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256
        from d left join cut using (doc_id)
    """,
    "op10_source_mixing": r"""
        with recursive d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents
        ), s as (
            select source, sum(size)::bigint source_size, 2.0::double * sum(size) most,
                [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double weight
            from d group by source
        ), l as (  -- the level if all that reach their limit before this source stop there
            select s.*, (1.5::double * (select sum(source_size) from s)
                    - coalesce((select sum(o.most) from s o where o.most / o.weight < s.most / s.weight), 0))
                / (select sum(o.weight) from s o where o.most / o.weight >= s.most / s.weight) own
            from s
        ), t as (
            select source, source_size, least(most, coalesce((select own from l where own <= most / weight order by most / weight limit 1) * weight, most)) target from l
        ), g as (
            select *, floor(target + 0.5)::bigint goal, greatest(16, least(1024, (select floor(sum(target) / 65536) from t)))::bigint block from t
        ), c as (
            select *, ((goal + block - 1) // block)::bigint slots,
                coalesce(sum((goal + block - 1) // block) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint first
            from g
        ), n as (
            select coalesce(sum(slots), 0)::bigint n from c
        ), euclid as (  -- the terms of each near step's continued fraction
            select near + k step, k, n a, (near + k) b, 0::bigint term
            from (select n, round(n * ((sqrt(5.0::double) - 1) / 2))::bigint near from n), range(-64, 65) r(k) where near + k > 0 and near + k < n
            union all
            select step, k, b, a % b, a // b from euclid where b > 0
        ), step as (
            select coalesce((
                select step from euclid group by step, k having min(case when b = 0 then a end) = 1 order by max(term), abs(k), step limit 1
            ), 1) step
        ), slot as (
            select source, slot, row_number() over (partition by source order by slot) - 1 rank
            from (select range slot, (range + 1) * step % n place from n, step, range(0, (select n from n))) p
            join c on place >= first and place < first + slots
        ), placed as (
            select d.doc_id, d.source, size, source_size, target, goal, block,
                coalesce(sum(size) over (partition by d.source order by substr(md5(coalesce(d.doc_id::varchar, '-') || ':' || size), 1, 15), d.doc_id, size
                    rows between unbounded preceding and 1 preceding), 0)::bigint start
            from d join c on d.source is not distinct from c.source where size > 0
        ), read as (
            select *, greatest(0, least(start + size, goal) - start) one, start // block rank_one,
                greatest(0, least(start + source_size + size, goal) - start - source_size) two, (start + source_size) // block rank_two
            from placed
        )
        select doc_id, read.source, size, source_size, target, (one + two)::bigint taken,
            case when one > 0 then a.slot end slot, case when two > 0 then b.slot end second_slot
        from read
            left join slot a on a.source is not distinct from read.source and a.rank = rank_one
            left join slot b on b.source is not distinct from read.source and b.rank = rank_two
        union all
        select doc_id, d.source, size, source_size, target, 0, null, null from d join t on d.source is not distinct from t.source where size = 0
    """,
    "op11_source_divergence": r"""
        with d as (
            select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') words
            from documents
        ), w as (
            select id, lang, source, unnest(words) term from d
        ), k as (
            select lang, term, count(*) lang_n from w group by all having count(distinct id) >= 10
        ), l as (
            select lang, count(*) v, sum(lang_n) + 2 * count(*) total from k group by lang
        ), g as (
            select distinct lang, source from d
        ), c as (
            select lang, source, term, count(*) n from w semi join k using (lang, term) group by all
        ), z as (
            select g.lang, g.source, coalesce(sum(n), 0) + 2 * coalesce(any_value(v), 0) total
            from g left join c using (lang, source) left join l on l.lang = g.lang group by all
        ), p as (  -- every group and kept term
            select z.lang, z.source, k.term, coalesce(n, 0) n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // z.total)::hugeint p,
                (1 + 1000000000::hugeint * (lang_n + 2) // l.total)::hugeint q
            from z join k using (lang) join l using (lang) left join c on c.lang = z.lang and c.source = z.source and c.term = k.term
        ), f as (
            select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), r as (
            select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value
            from g a join g b on a.lang = b.lang and a.source <> b.source
                left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all
            select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q
        )
        select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int rank
        from r qualify part = 'pair' or rank <= 10
    """,
    "op12_conversation_repair": r"""
        with recursive crc_table as (
            select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t
        ), c as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') label
            from conversations
        ), k as (
            select c.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(label) + 1), lambda i: ascii(label[i]::varchar)::bigint)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 kind
            from c, crc_table
        ), d as (
            select conv_id, turn, case kind when 4 then 'user' else role end as role,
                case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
            from k, range(2) copy(n) where kind <> 0 and (n = 0 or kind = 3)
        ), n as (
            select *, row_number() over (partition by conv_id, role, text order by turn nulls first) nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ended from d
        ), f as (
            select conv_id, turn, role, text, left(role, 1) initial,
                case when ended = '' then 'blank' when nth > 1 then 'duplicate' when right(ended, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
                row_number() over o place, lag(left(role, 1)) over o before
            from n window o as (partition by conv_id order by turn nulls first, role, text, nth)
        ), steps(conv_id, place, e, s, u, a) as (  -- cost in 12 digits, then the edits with the roles they make; 'x' where there is no way
            select distinct conv_id, 0::bigint, lpad('0', 12, '0'), 'x', 'x', 'x' from c
            union all
            select conv_id, place, lpad((left(e, 12)::bigint + 2)::varchar, 12, '0') || e[13:] || 'D',
                least(case when s < 'x' then lpad((left(s, 12)::bigint + 2)::varchar, 12, '0') || s[13:] || 'D' else 'x' end,
                    case when stays and initial = 's' then lpad((left(e, 12)::bigint + extra)::varchar, 12, '0') || e[13:] || 'K' else 'x' end),
                least(case when u1 < 'x' then lpad((left(u1, 12)::bigint + 2)::varchar, 12, '0') || u1[13:] || 'D' else 'x' end,
                    case when stays and initial = 'u' and free < 'x' then lpad((left(free, 12)::bigint + extra)::varchar, 12, '0') || free[13:] || 'K' else 'x' end,
                    case when stays and free < 'x' then lpad((left(free, 12)::bigint + extra + 1)::varchar, 12, '0') || free[13:] || 'Ru' else 'x' end),
                least(case when a1 < 'x' then lpad((left(a1, 12)::bigint + 2)::varchar, 12, '0') || a1[13:] || 'D' else 'x' end,
                    case when stays and initial = 'a' and u1 < 'x' then lpad((left(u1, 12)::bigint + extra)::varchar, 12, '0') || u1[13:] || 'K' else 'x' end,
                    case when stays and u1 < 'x' then lpad((left(u1, 12)::bigint + extra + 1)::varchar, 12, '0') || u1[13:] || 'Ra' else 'x' end)
            from (
                select p.conv_id, f.place, e, s, initial, fault not in ('blank', 'duplicate') stays, case fault when 'truncated' then 5 else 0 end extra,
                    least(u, lpad((left(least(e, s, a), 12)::bigint + 5)::varchar, 12, '0') || least(e, s, a)[13:] || 'Iu') u1,
                    least(a, case when u < 'x' then lpad((left(u, 12)::bigint + 5)::varchar, 12, '0') || u[13:] || 'Ia' else 'x' end) a1,
                    least(e, s, a, case when u < 'x' then lpad((left(u, 12)::bigint + 5)::varchar, 12, '0') || u[13:] || 'Ia' else 'x' end) free
                from steps p join f on f.conv_id is not distinct from p.conv_id and f.place = p.place + 1
            )
        ), best as (
            select conv_id, least(e, a, case when u < 'x' then lpad((left(u, 12)::bigint + 5)::varchar, 12, '0') || u[13:] || 'Ia' else 'x' end) best
            from steps qualify row_number() over (partition by conv_id order by place desc) = 1
        ), part as (  -- each row's inserts and edit, and what stands behind the last row
            select conv_id, regexp_extract_all(best[13:], '(?:I[ua])*(?:D|K|R[ua]|$)') parts from best
        ), piece as (
            select conv_id, unnest(parts) piece, unnest(range(1, len(parts) + 1)) place from part
        ), line as (
            select conv_id, place, replace(replace(regexp_extract(piece, '^(I[ua])*'), 'Iu', 'user:' || chr(10)), 'Ia', 'assistant:' || chr(10))
                || case when piece like '%K' then role || ':' || text || chr(10) when piece like '%Ru' then 'user:' || text || chr(10)
                    when piece like '%Ra' then 'assistant:' || text || chr(10) else '' end line
            from piece left join f using (conv_id, place)
        ), made as (
            select conv_id, string_agg(line, '' order by place) made from line group by conv_id
        ), total as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal
            from f group by conv_id
        )
        select best.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
            left(best, 12)::bigint as cost, translate(best[13:], 'ua', '') audit, sha256(coalesce(left(made, -1), '')) repaired_sha256
        from best left join total on total.conv_id is not distinct from best.conv_id left join made on made.conv_id is not distinct from best.conv_id
    """,
}
