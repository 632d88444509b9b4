"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_ans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.ans import read_tokens, write_tokens

    blocks, freq = write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return read_tokens(blocks, freq, digest=True)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.topk import quantised, top_k

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 20 = 0"), 20).withColumnRenamed("id", "vec_id")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.mixing import mixture

    mixed = mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "positions")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.md5("text").alias("text_md5"))


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.common import stored
    from eddymesh.llm.media import describe, store_texts

    found = describe(stored(store_texts(table(spark, sf_dir, "documents")), "media"), digest=True)
    ranges = F.array_join(F.transform("key_ranges", lambda r: F.concat_ws("-", r[0], r[1])), ",")
    feature = F.concat(F.trim("codec"), F.lit(";"), "duration", F.lit("/"), "timescale", F.lit(";"), "samples", F.lit(";"), ranges)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.token_count import token_counts

    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.quality import fitted, held_out, quality_scores

    docs = table(spark, sf_dir, "documents")
    found = quality_scores(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("of.doc_id", held_out(F.col("of.doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eddymesh.llm.brown import brown_scores

    return brown_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_ans_tokens, op3_topk, op4_curriculum_mix, op5_line_dedup, op6_iso_media, op7_best_fit_pack, op8_token_counts, op9_quality_knn, op10_brown_lm)}

SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as g from w),
        n as (select w.doc_id, count(s.g) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
        i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * c >= 80 * (x.n + y.n - c)),
        r(doc_id, reach) as (select doc_id, doc_id from n union select r.doc_id, l.b from r join l on l.a = r.reach)
        select n.doc_id, n.n as n_shingles, min(r.reach) as component_id, n.doc_id = min(r.reach) as kept from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n""",
    "op3_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, r.vec_id, list_inner_product(q.v::double[], r.v::double[])::bigint as score from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
        k as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
        select query_id, rank, vec_id, score from k where rank <= 20""",
    "op4_curriculum_mix": r"""
        with d as (select doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from d group by source),
        w as (select *, [5.0, 2.0, 1.0][(turn % 3 + 1)::int]::double as weight from s),
        l as (select *, 2 * source_size / weight as level from w),
        a as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by level, turn rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by level, turn rows between current row and unbounded following) as at_level from l),
        t as (select *, least((2 * source_size)::double, coalesce((select arg_min(at_level, (level, turn)) from a where level >= at_level) * weight, 2.0 * source_size)) as target from a),
        m as (select d.*, t.turn, t.source_size, t.target, floor(t.target / t.source_size)::bigint as whole,
                sum(size) over (partition by d.source order by h, doc_id, size, text rows between unbounded preceding and current row) - size / 2.0::double as middle
              from d join t on d.source is not distinct from t.source),
        p as (select *, case when size = 0 then 0 else whole + (middle <= target - whole * source_size)::int end as passes from m),
        u as (select *, least(1.0::double, middle / target) as u0, least(1.0::double, (middle + source_size) / target) as u1 from p),
        x as (select *, case turn % 3 when 0 then (sqrt(6.25::double + 10.0::double * (u0 * 5.0::double)) - 2.5::double) / 5.0::double
                                      when 1 then (sqrt(9.0::double + -4.0::double * (u0 * 2.0::double)) - 3.0::double) / -2.0::double else u0 end as t0,
                        case turn % 3 when 0 then (sqrt(6.25::double + 10.0::double * (u1 * 5.0::double)) - 2.5::double) / 5.0::double
                                      when 1 then (sqrt(9.0::double + -4.0::double * (u1 * 2.0::double)) - 3.0::double) / -2.0::double else u1 end as t1 from u)
        select doc_id, size, source_size, target, (passes * size)::bigint as taken,
               case when passes = 0 then []::double[] when passes = 1 then [least(1.0::double, greatest(0.0::double, t0))] else [least(1.0::double, greatest(0.0::double, t0)), least(1.0::double, greatest(0.0::double, t1))] end as positions from x""",
    "op5_line_dedup": r"""
        with l as (select row, doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line
                   from (select *, row_number() over (order by doc_id) as row from documents)),
        c as (select row, doc_id, line, content, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) as n, ('0x' || substr(md5(content), 1, 15))::bigint as h from l),
        p as (select *, sum(n) over (partition by row order by line) - n as n_before, row_number() over (partition by row order by line) - 1 as pos, sum(n) over (partition by row) as total from c where n > 0),
        w as (select *, min({'h': h, 'pos': pos}) over (partition by row order by n_before range between current row and 49 following) as least from p),
        f as (select distinct row, doc_id, least.h as h, least.pos as pos from w where total - n_before >= 50),
        o as (select *, first_value({'row': row, 'pos': pos}) over (partition by h order by doc_id, row, pos) as f0 from f),
        s as (select row, pos, f0.row as row0, pos - f0.pos as shift from o where row <> f0.row or pos <> f0.pos),
        d as (select distinct row, row0, shift from s),
        m as (select d.row, d.row0, d.shift, a.pos, a.n, a.line, coalesce(a.h = b.h, false) as same from d join p a on a.row = d.row left join p b on b.row = d.row0 and b.pos = a.pos - d.shift),
        g as (select *, sum((not same)::int) over (partition by row, row0, shift order by pos) as island from m),
        r as (select row, row0, shift, island, sum(n) as words from g where same group by all),
        k as (select distinct g.row, g.row0, g.shift, g.island from s join g on g.row = s.row and g.row0 = s.row0 and g.shift = s.shift and g.pos = s.pos where g.same),
        x as (select distinct g.row, g.line from g join k using (row, row0, shift, island) join r using (row, row0, shift, island) where g.same and r.words >= 50)
        select q.doc_id, coalesce(len(string_split(q.text, chr(10))), 0)::bigint as n_lines, (select count(*) from x where x.row = q.row) as n_removed,
               coalesce((select string_agg(x.line::varchar, ',' order by x.line) from x where x.row = q.row), '') as removed,
               case when q.text is not null then md5(coalesce((select string_agg(c.content, chr(10) order by c.line) from c where c.row = q.row and not exists (select 1 from x where x.row = c.row and x.line = c.line)), '')) end as text_md5
        from (select *, row_number() over (order by doc_id) as row from documents) q""",
}
