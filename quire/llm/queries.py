"""The queries of this subpackage: ``(spark, sf_dir) -> DataFrame``, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import html_extract, language, line_dedup, mixing, near_dedup, nearest, order_minhash, packing, quality, runs, simhash, tokens, vector_codes
from quire.llm.shared import Scratch


#: Target weights of the sources in the mixture; a source that is not named follows when the others are through.
MIX_WEIGHTS = {f"src{i}": (4.0, 2.0, 1.0, 1.0)[i % 4] for i in range(20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_ann_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4).drop("text_hash")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(_table(spark, sf_dir, "documents"), 4 * _partitions(spark))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'tokens').base}/ids"
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2, files=_partitions(spark))
    return tokens.token_spans(spark, path)


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines", "lines_kept")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit_languages(docs))
    return found.select("doc_id", quality.held_out(folds=4, fold=2).alias("held_out"), "lang_pred", "score", "langs")


def op11_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op12_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), tail=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ann_collision_counting, op2_quality_classifier, op3_minhash_near_dedup, op4_html_extract, op5_cost_packing, op6_order_minhash, op7_token_ids, op8_fuzzy_line_dedup, op9_pfair_mixing, op10_language_id, op11_simhash_bk_tree, op12_va_file_codes, op13_periodic_runs]
    return {f.__name__: f for f in found}


#: All pairs of documents that share a shingle, counted in full, and who reaches whom over links.
NEAR_SQL = r"""WITH RECURSIVE wd AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)-2), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]||' '||w[i+3]) END) AS s FROM wd),
sz AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sh), one AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM sh),
lk AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM one x JOIN one y ON x.h=y.h AND x.doc_id<>y.doc_id GROUP BY 1,2) c JOIN sz p ON p.doc_id=a JOIN sz q ON q.doc_id=b WHERE 100*c.n>=80*(p.n+q.n-c.n)),
rc(doc_id, root) AS (SELECT doc_id, doc_id FROM sz UNION SELECT lk.b, rc.root FROM rc JOIN lk ON lk.a=rc.doc_id WHERE rc.root<lk.b)
SELECT sz.doc_id, n AS n_shingles, min(root) AS component_id, min(root)=sz.doc_id AS kept FROM sz JOIN rc USING (doc_id) GROUP BY sz.doc_id, n"""


def _codes_sql() -> str:
    """The rounds of ``vector_codes`` one after the other: all distances, the nearest entry, integer means."""
    ctes = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096*x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)",
        "pc AS MATERIALIZED (SELECT vec_id, ix//(n//8) AS part, ix%(n//8) AS pos, x FROM (SELECT vec_id, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS ix FROM v))",
        "b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM pc JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id)-1 AS entry FROM v ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, entry, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) AS rn FROM (SELECT vec_id, pc.part, entry, sum((x-c)*(x-c))::BIGINT AS dist FROM pc JOIN b{k} b ON b.part=pc.part AND b.pos=pc.pos GROUP BY 1,2,3)) WHERE rn=1)")
        if k < vector_codes.ROUNDS:
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT a.part, a.entry, pos, floor(sum(x)/count(*))::BIGINT AS c FROM a{k} a JOIN pc ON pc.vec_id=a.vec_id AND pc.part=a.part GROUP BY 1,2,3) m ON m.part=b.part AND m.entry=b.entry AND m.pos=b.pos)")
    last = vector_codes.ROUNDS
    ctes.append(f"cd AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{last} GROUP BY 1)")
    ctes.append(f"bk AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM b{last})")
    return "WITH " + ",\n".join(ctes) + " SELECT cd.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM cd JOIN v USING (vec_id), bk"


#: Runs by comparing every two equal words of a text that are close enough: stretches of them at one distance are runs of that period.
RUNS_SQL = r"""WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w1 AS (SELECT *, len(w)::BIGINT AS n, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x>>1, (x&1)*3988292384::BIGINT))) AS crc FROM w0),
w2 AS (SELECT *, xor(crc, 4294967295::BIGINT)//10 AS g, xor(crc, 4294967295::BIGINT)%10=0 AND n>0 AS tail FROM w1),
w3 AS (SELECT *, CASE WHEN tail THEN g%n ELSE n END AS a, CASE WHEN tail THEN 1+(n-g%n)//(3+g%8) ELSE 1 END AS p FROM w2),
ix AS (SELECT doc_id, n, w, a, p, unnest(range(n)) AS i FROM w3),
wd AS MATERIALIZED (SELECT doc_id, n, i, w[1+CASE WHEN i<a THEN i ELSE a+(i-a)%p END] AS word FROM ix),
eq AS (SELECT x.doc_id, x.n, x.i, y.i-x.i AS q FROM wd x JOIN wd y ON x.doc_id=y.doc_id AND x.word=y.word AND y.i>x.i AND y.i-x.i<=x.n//4),
st AS (SELECT doc_id, q, min(i) AS start, count(*)+q AS length FROM (SELECT *, i-row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isl FROM eq) GROUP BY doc_id, q, isl HAVING count(*)+q>=greatest(6, 4*q)),
rn AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY 1,2,3),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE/period DESC, start, period) AS k FROM rn) WHERE k=1),
ls AS (SELECT doc_id, count(*) AS n_runs, string_agg(start||','||length||','||period||chr(10), '' ORDER BY start, period) AS listed FROM rn GROUP BY 1),
gn AS (SELECT DISTINCT doc_id, unnest(range(start+period, start+length)) AS i FROM rn),
kp AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM wd ANTI JOIN gn USING (doc_id, i) GROUP BY 1)
SELECT w0.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000*length//period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w0 LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN kp USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op13_periodic_runs": RUNS_SQL, "op3_minhash_near_dedup": NEAR_SQL, "op12_va_file_codes": _codes_sql()}
