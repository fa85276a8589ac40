"""Every query of the library by name, with its SQL for the oracle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import containers as K
from .functions import context, ocr, policy, provenance, redact, stego
from .operators import datasets, inject, metrics, models, vector
from .oracles import SQL
from .plans import analyse, simulate, views
from .sources import scratch

TREES = 350
_registry: dict = {}


def query(f):
    _registry[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(cols: dict[str, Column], digits: int = 6) -> list[Column]:
    return [(F.round(v, digits) if "score" in k else v).alias(k) for k, v in cols.items()]


def _scored(spark, sf) -> DataFrame:
    return policy.evaluate(simulate.bundle(spark, sf), simulate.probability())


@query
def analyse_decisions(spark, sf):
    """Decision per item: the flagship."""
    out = _scored(spark, sf)
    return out.select("doc_id", "filename", "decision", *[F.round(c, 6).alias(c) for c in ("risk_score", "signal_score", "p")])


@query
def decision_counts(spark, sf):
    return _scored(spark, sf).groupBy("decision", "feature_category").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 6).alias("avg_risk"))


@query
def filename_features(spark, sf):
    return simulate.items(spark, sf).select("doc_id", "filename", *_rounded(context.filename_features(F.col("filename"))))


@query
def caption_features(spark, sf):
    return simulate.items(spark, sf).select("doc_id", "caption", *_rounded(context.caption_features(F.col("caption"))))


@query
def conversation_caption_scores(spark, sf):
    own = _table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("caption"))
    return own.select("conv_id", "turn", *_rounded(context.caption_features(F.col("caption"))))


@query
def page_filename_features(spark, sf):
    name = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", "")
    own = _table(spark, sf, "pages").select("page_id", name.alias("filename"))
    cols = context.filename_features(F.col("filename"))
    cols.pop("filename_length")
    return own.select("page_id", *_rounded(cols))


@query
def filename_entropy(spark, sf):
    return simulate.items(spark, sf).select("doc_id", F.round(context.filename_entropy_norm(F.col("filename")), 6).alias("filename_entropy_norm"))


@query
def text_char_entropy(spark, sf):
    """Entropy by explode and two-level counts: for texts too long for array functions."""
    chars = _table(spark, sf, "benchmark").where("text <> ''").select("item_id", F.explode(F.split("text", "")).alias("ch"))
    counts = chars.groupBy("item_id", "ch").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy("item_id").agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"))


@query
def names_species(spark, sf):
    return simulate.items(spark, sf).select("doc_id", context.names_species(F.col("filename"), simulate.ANIMALS).alias("filename_has_species_keyword"))


@query
def species_lookup_default(spark, sf):
    return simulate.items(spark, sf).groupBy("animal").agg(F.first("species_sensitivity").alias("species_sensitivity"), F.count("*").alias("n"))


@query
def species_unknown_anti(spark, sf):
    own = simulate.items(spark, sf).select("doc_id", "animal", context.species_key(F.col("animal")).alias("species"))
    return own.join(F.broadcast(simulate.species_table(spark)), "species", "left_anti").select("doc_id", "animal")


@query
def part_lookup_default(spark, sf):
    own = _table(spark, sf, "part").select("p_partkey", F.split("p_name", " ")[0].alias("animal"))
    return simulate.with_sensitivity(own).select("p_partkey", F.col("species_sensitivity").alias("sensitivity"))


@query
def keyword_hits_documents(spark, sf):
    own = _table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    return own.select("doc_id", context.count_of(F.col("t"), C.LOCATION_KEYWORDS).alias("keyword_hits"))


@query
def keyword_semi_join(spark, sf):
    """Documents with any keyword: an OR of contains, not a nested-loop join."""
    own = _table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return own.where(context.any_of(F.col("t"), C.LOCATION_KEYWORDS)).select("doc_id")


@query
def keyword_document_frequency(spark, sf):
    own = _table(spark, sf, "documents").select(F.lower("text").alias("t"))
    found = F.filter(F.array(*[F.when(F.col("t").contains(w), F.lit(w)) for w in C.LOCATION_KEYWORDS]), lambda w: w.isNotNull())
    return own.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"))


@query
def caption_redaction(spark, sf):
    return simulate.items(spark, sf).select("doc_id", redact.redact_caption(F.col("caption")).alias("safe_caption"))


@query
def document_redaction(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(redact.redact_caption(F.col("text")), 256).alias("safe_sha256"))


def _verdict_rows(spark, sf):
    # outer: no filter on the array is inferred, which would repeat every expression below it
    own = _scored(spark, sf).select("doc_id", F.explode_outer("verdicts").alias("v"))
    return own.select("doc_id", "v.category", "v.level", F.round("v.score", 6).alias("score"))


@query
def category_verdicts_unpivot(spark, sf):
    return _verdict_rows(spark, sf)


@query
def category_level_counts(spark, sf):
    return _verdict_rows(spark, sf).groupBy("category", "level").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query
def risk_score_components(spark, sf):
    return _scored(spark, sf).select("doc_id", *[F.round(v, 6).alias(f"{k}_score") for k, v in policy.category_scores().items()], F.round("blended_score", 6).alias("blended_score"))


@query
def strong_evidence_override(spark, sf):
    return _scored(spark, sf).where("overridden").select("doc_id", "base_decision", "decision", F.round("blended_score", 6).alias("blended_score"), F.round("risk_score", 6).alias("risk_score"))


@query
def flagged_factors(spark, sf):
    return simulate.bundle(spark, sf).select("doc_id", F.array_join(policy.factors(), "|").alias("factors"))


@query
def factor_counts(spark, sf):
    own = simulate.bundle(spark, sf).select(F.explode_outer(policy.factors()).alias("f")).where("f is not null")
    return own.groupBy(F.split("f", ":")[0].alias("factor")).agg(F.count("*").alias("n"))


@query
def stratified_split(spark, sf):
    return simulate.manifest(spark, sf).select("image_id", "animal", "split", "feature_category", "feature_type", "risk_label")


@query
def split_counts(spark, sf):
    return simulate.manifest(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.sum("risk_label").alias("n_pos"))


@query
def stratified_cap(spark, sf):
    own = simulate.manifest(spark, sf).select("doc_id", "split", "feature_category")
    return datasets.stratified_cap(own, 300)


@query
def manifest_rows(spark, sf):
    return simulate.manifest(spark, sf).select("image_id", "animal", "split", "feature_category", "feature_type", "filename", "injected", "risk_label", "species_sensitivity", "caption")


@query
def species_stats(spark, sf):
    return datasets.species_stats(simulate.items(spark, sf))


@query
def species_counts(spark, sf):
    return simulate.items(spark, sf).groupBy("animal").agg(F.count("*").alias("n"), F.round(F.avg("species_sensitivity"), 6).alias("sensitivity")).orderBy("animal")


@query
def category_distribution(spark, sf):
    return datasets.category_distribution(simulate.items(spark, sf).withColumn("split", F.lit("train")))


@query
def draw_category(spark, sf):
    return simulate.items(spark, sf).select("doc_id", "animal", "feature_category", "ext")


@query
def leaky_caption_gen(spark, sf):
    return simulate.items(spark, sf).select("doc_id", simulate.leaky_caption(F.col("animal")).alias("caption"))


@query
def benign_caption_gen(spark, sf):
    return datasets.benign_caption_rows(simulate.items(spark, sf))


@query
def leaky_filename_gen(spark, sf):
    c = F.col
    return simulate.items(spark, sf).select("doc_id", simulate.leaky_filename(c("animal"), c("serial"), c("ext")).alias("leaky"), simulate.benign_filename(c("serial"), c("ext")).alias("benign"))


@query
def mixed_union(spark, sf):
    cols = ["image_id", "animal", "split", "feature_category", "feature_type", "filename", "caption", "risk_label"]
    return simulate.manifest(spark, sf).select(*cols).unionByName(datasets.mixed_rows(_table(spark, sf, "documents")).select(*cols))


@query
def global_serial(spark, sf):
    own = simulate.manifest(spark, sf).select("image_id", "split", "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    return datasets.with_serial(own, ["split", "_h", "doc_id"], [F.col("split"), F.substring("_h", 1, 2)]).select("image_id", F.col("serial").alias("global_serial"))


def _truth(spark, sf) -> DataFrame:
    """Labels with a stand-in score from text length."""
    own = _table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")).join(_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return own.select("doc_id", "y", ((F.col("n_chars") % 97).cast("double") / 96.0).alias("score"), (F.col("n_chars") % 97 >= 48).cast("int").alias("pred"))


def _nine(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def confusion_matrix(spark, sf):
    return metrics.confusion(_truth(spark, sf))


@query
def binary_metrics(spark, sf):
    return _nine(metrics.binary_metrics(_truth(spark, sf)))


@query
def classification_report(spark, sf):
    return _nine(metrics.classification_report(_truth(spark, sf)))


@query
def roc_auc(spark, sf):
    return _nine(metrics.roc_auc(_truth(spark, sf)))


@query
def class_weight(spark, sf):
    return _nine(metrics.class_weight(simulate.items(spark, sf), "risk_label"))


@query
def calibration_topk(spark, sf):
    return analyse_decisions(spark, sf).select("doc_id", "risk_score").orderBy(F.desc("risk_score"), "doc_id").limit(10)


@query
def sha256_text(spark, sf):
    return _table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@query
def hash_chain(spark, sf):
    own = _table(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("h0"), F.concat(F.lit("clean:"), "text").alias("s"))
    own = own.withColumn("h1", F.sha2("s", 256))
    return own.select("item_id", "h0", "h1", F.sha2(F.concat("s", "h0", "h1"), 256).alias("h2"))


def _jpeg_files(spark, sf) -> DataFrame:
    """A minimal JPEG around each benchmark text."""
    head, tail = F.unhex(F.lit("FFD8FFE000040000FFDA0002")), F.unhex(F.lit("FFD9"))
    return _table(spark, sf, "benchmark").select("item_id", F.concat(head, F.col("text").cast("binary"), tail).alias("content"))


def _png_files(spark, sf) -> DataFrame:
    """A small picture for each benchmark item."""
    @F.pandas_udf("binary")
    def make(ids: pd.Series) -> pd.Series:
        return pd.Series([K.encode_png((np.arange(11 * 9 * 3).reshape(11, 9, 3) * (int(i) % 7 + 1)) % 251) for i in ids])

    return _table(spark, sf, "benchmark").select("item_id", make("item_id").alias("content"))


@query
def jpeg_comment_roundtrip(spark, sf):
    payload = F.concat(F.lit(C.JPEG_MARKER), F.col("item_id").cast("string"))
    own = _jpeg_files(spark, sf).withColumn("marked", K.insert_comment_column(F.col("content"), payload.cast("binary")))

    @F.pandas_udf("struct<stripped:string,payload:string>")
    def back(marked: pd.Series) -> pd.DataFrame:
        import hashlib

        return pd.DataFrame([{"stripped": hashlib.sha256(K.strip_comment(x)).hexdigest(), "payload": K.extract_comment(x).decode()} for x in marked])

    return own.withColumn("b", back("marked")).select("item_id", F.sha2("marked", 256).alias("marked"), "b.stripped", "b.payload")


@query
def png_text_roundtrip(spark, sf):
    @F.pandas_udf("struct<payload:string,same:boolean>")
    def there_and_back(content: pd.Series, payload: pd.Series) -> pd.DataFrame:
        rows = []
        for data, p in zip(content, payload, strict=True):
            marked = K.insert_text(data, b"k", p.encode())
            rows.append({"payload": K.extract_text(marked, b"k").decode(), "same": K.strip_text(marked, b"k") == data})
        return pd.DataFrame(rows)

    own = _png_files(spark, sf).withColumn("p", F.concat(F.lit("note:"), F.col("item_id").cast("string")))
    return own.withColumn("r", there_and_back("content", "p")).select("item_id", "r.payload", "r.same")


def _records(spark, sf) -> DataFrame:
    own = _table(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("h0"), F.sha2(F.concat(F.lit("clean:"), "text"), 256).alias("h1"))
    fields = provenance.record_fields(F.col("h0"), F.col("h1"), F.lit("2024-01-01T00:00:00+00:00"), F.substring("h1", 1, 32), F.lit("sanitized"), F.lit("unsafe"), F.lit("sanitized"))
    return own.withColumn("record", provenance.record_json(fields))


@query
def provenance_record_json(spark, sf):
    return _records(spark, sf).select("item_id", "record", F.sha2("record", 256).alias("record_hash"))


@query
def required_fields_missing(spark, sf):
    kind = F.col("item_id") % 3
    no_parent = F.replace("record", F.concat(F.lit('"parent_hash": "'), "h0", F.lit('", ')), F.lit(""))
    renamed = F.replace("record", F.lit('"version"'), F.lit('"edition"'))
    broken = F.when(kind == 1, no_parent).when(kind == 2, renamed).otherwise(F.col("record"))
    return _records(spark, sf).select("item_id", F.array_join(provenance.missing_fields(broken), ",").alias("missing"))


@query
def verify_status(spark, sf):
    """Whole, changed, parentless and unmarked files, verified."""
    kind = F.col("item_id") % 4
    own = _jpeg_files(spark, sf).withColumn("clean", K.stripped("content")).withColumn("h1", F.sha2("clean", 256))
    h0 = F.when(kind == 2, F.lit("")).otherwise(F.sha2("content", 256))
    fields = provenance.record_fields(h0, F.col("h1"), F.lit("2024-01-01T00:00:00+00:00"), F.substring("h1", 1, 32), F.lit("sanitized"), F.lit("unsafe"), F.lit("sanitized"))
    marked = provenance.embed(F.col("clean"), provenance.record_json(fields), F.lit(C.JPEG_MARKER), F.lit(C.PNG_MARKER))
    final = F.when(kind == 1, F.concat(marked, F.lit("tail").cast("binary"))).when(kind == 3, F.col("clean")).otherwise(marked)
    out = own.select("item_id", provenance.verify(final).alias("v"))
    return out.select("item_id", "v.provenance_found", "v.valid", F.array_join("v.reasons", ",").alias("reasons"))


@query
def tamper_detection(spark, sf):
    """Bytes after a JPEG and chunks in a PNG are noticed; bytes after a PNG's end are not part of its artifact."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.lit(h).alias("how")) for k, h in (("JPEG", "tail"), ("PNG", "tail"), ("PNG", "chunk"))]))
    both = _jpeg_files(spark, sf).withColumnRenamed("content", "jpeg").join(_png_files(spark, sf).withColumnRenamed("content", "png"), "item_id")
    own = both.select("item_id", "jpeg", "png", kinds.alias("t")).select("item_id", "t.format", "t.how", F.when(F.col("t.format") == "JPEG", F.col("jpeg")).otherwise(F.col("png")).alias("content"))
    sealed = provenance.sanitize(own, stamp=F.lit("2024-01-01 00:00:00").cast("timestamp"))

    @F.pandas_udf("binary")
    def change(data: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([x + b"more" if h == "tail" else provenance.tamper(x) for x, h in zip(data, how, strict=True)])

    return sealed.select("item_id", "format", "how", (~provenance.verify(change("sanitized", "how"))["valid"]).alias("detected"))


@query
def ocr_token_dedupe(spark, sf):
    return ocr.dedupe(datasets.ocr_tokens(simulate.items(spark, sf))).select("image_id", "psm_order", "seq", "text", "x", "y")


def _read(spark, sf) -> DataFrame:
    return ocr.per_image(ocr.dedupe(datasets.ocr_tokens(simulate.items(spark, sf))))


@query
def ocr_mean_conf(spark, sf):
    return _read(spark, sf).select("image_id", "num_text_boxes", F.round("mean_confidence", 6).alias("mean_confidence"), "raw_text")


@query
def ocr_hits(spark, sf):
    return _read(spark, sf).select("image_id", F.explode(ocr.hits(F.col("raw_text"))).alias("h")).groupBy("image_id", "h.label", "h.text").agg(F.count("*").alias("n"))


@query
def ocr_bbox(spark, sf):
    """The box around each hit."""
    own = _read(spark, sf).select("image_id", "tokens", F.posexplode(ocr.hits(F.col("raw_text"))).alias("ord", "h"))
    return own.select("image_id", "ord", "h.label", "h.text", ocr.locate(F.col("tokens"), F.col("h.text")).alias("bbox"))


@query
def ocr_redaction_boxes(spark, sf):
    b = F.col("bbox")
    box = redact.padded_box(b[0], b[1], b[2], b[3], F.lit(640), F.lit(480))
    return ocr_bbox(spark, sf).select("image_id", "ord", box.alias("r")).where("r is not null").select("image_id", "ord", "r.*")


def _bytes(spark, sf) -> DataFrame:
    """Embeddings quantised to byte values: a stand-in for pixels."""
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 128.0).cast("long"))
    return _table(spark, sf, "embeddings").select("vec_id", v.alias("v"))


def _planes(spark, sf) -> DataFrame:
    bits = stego.bits_of(F.col("v"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a).cast("double")
    own = _bytes(spark, sf).withColumn("bits", bits).withColumn("lsb_mean", mean(F.col("bits")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("bits") - 1) / 8).cast("int")), lambda b: mean(F.slice(F.col("bits"), b * 8 + 1, F.lit(8))))
    own = own.withColumn("blocks", blocks).withColumn("bm", F.aggregate("blocks", F.lit(0.0), lambda s, x: s + x) / F.size("blocks"))
    var = F.aggregate(F.transform("blocks", lambda x: (x - F.col("bm")) * (x - F.col("bm"))), F.lit(0.0), lambda s, x: s + x) / F.size("blocks")
    own = own.withColumn("block_variance", var)
    return own.withColumns(stego.lsb_columns(F.col("lsb_mean"), F.col("block_variance")))


@query
def lsb_stats(spark, sf):
    return _planes(spark, sf).select("vec_id", F.round("lsb_mean", 12).alias("lsb_mean"), F.round("lsb_variance", 12).alias("lsb_variance"))


@query
def lsb_block_variance(spark, sf):
    return _planes(spark, sf).select("vec_id", F.round("block_variance", 12).alias("block_variance"))


@query
def lsb_score(spark, sf):
    return _planes(spark, sf).select("vec_id", F.round("lsb_entropy_norm", 9).alias("lsb_entropy_norm"), F.round("lsb_variance_score", 9).alias("lsb_variance_score"))


@query
def byte_entropy(spark, sf):
    return _bytes(spark, sf).select("vec_id", F.round(stego.byte_entropy(F.col("v")), 6).alias("byte_entropy"))


@query
def gps_decimal(spark, sf):
    """Degrees, minutes and hundredths of seconds, as EXIF has them, to signed degrees."""
    i = F.col("doc_id")
    parts = F.array(*[F.struct(n.alias("num"), F.lit(q).cast("long").alias("den")) for n, q in ((i % 90, 1), (i % 60, 1), ((i * 7) % 6000, 100))])
    ref = F.when(i % 2 == 0, "N").otherwise("S")
    return _table(spark, sf, "documents").select("doc_id", F.round(K.degrees_column(parts, ref), 9).alias("latitude"))


@query
def safe_filename(spark, sf):
    own = _table(spark, sf, "documents").where("text is not null")
    return own.select("doc_id", redact.safe_filename(F.sha2("text", 256), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(".JPG")).alias("safe_name"))


@query
def allowed_files(spark, sf):
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, F.col("filename")).when(kind == 1, F.upper("filename")).when(kind == 2, F.concat("filename", F.lit(".gif"))).otherwise(F.replace("filename", F.lit("."), F.lit("")))
    return simulate.items(spark, sf).select("doc_id", redact.allowed_file(name).alias("allowed"))


@query
def event_json_keys(spark, sf):
    own = _table(spark, sf, "events").where("props is not null").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return own.groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query
def upload_limit(spark, sf):
    small = F.octet_length("text") <= C.UPLOAD_LIMIT
    return _table(spark, sf, "documents").agg(F.count(F.when(small, 1)).alias("accepted"), F.count(F.when(~small, 1)).alias("rejected"))


def _with_content(items: DataFrame) -> DataFrame:
    """Real pictures for items: PNG bytes with the evidence of their category."""
    @F.pandas_udf("binary")
    def make(ids: pd.Series, parts: pd.Series, caption: pd.Series) -> pd.Series:
        out = []
        for i, p, text in zip(ids, parts, caption, strict=True):
            rng = np.random.default_rng(int(i))
            data = K.encode_png(rng.integers(0, 256, (16, 16, 4 if i % 5 == 0 else 3)), 1)
            if "A" in p:
                gps = {1: b"N\0", 2: [(12, 1), (58, 1), (1776, 100)], 3: b"E\0", 4: [(77, 1), (35, 1), (4056, 100)]}
                at = data.rfind(b"IEND") - 4
                data = data[:at] + K.chunk(b"eXIf", K.write_tiff({0x010F: b"Make\0"}, gps=gps)) + data[at:]
                data = K.insert_text(data, b"Author", b"someone")
            if "E" in p:
                data += bytes(rng.integers(0, 256, 200 + int(i) % 300, dtype=np.uint8))
            out.append(data)
        return pd.Series(out)

    own = items.withColumn("image_id", F.concat(F.lit("img_"), F.col("doc_id").cast("string")))
    return own.withColumn("content", make("doc_id", "parts", "caption"))


def _files(spark, sf) -> DataFrame:
    return _with_content(simulate.items(spark, sf))


@query
def png_chunk_counts(spark, sf):
    """Chunks of each picture by type, from the walker's rows."""
    own = _files(spark, sf).select(F.inline(K.segments("content")))
    return own.groupBy("tag").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query
def exif_gps_decode(spark, sf):
    own = _files(spark, sf).where("contains(parts, 'A')").select("doc_id", K.metadata("content").alias("m"))
    return own.select("doc_id", "m.has_gps", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"), "m.gps_field_count")


@query
def feature_vector_47(spark, sf):
    return vector.feature_vector(_files(spark, sf).select("image_id", "filename", "caption", "animal", "content"), datasets.ocr_tokens(simulate.items(spark, sf)))


@query
def sanitize_chain(spark, sf):
    out = provenance.sanitize(_files(spark, sf).select("doc_id", "caption", "content"), caption="caption", stamp=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("doc_id", "h0", "h1", "h2", "safe_name", "safe_caption", provenance.verify("sanitized")["valid"].alias("valid"))


@query
def injected_fields(spark, sf):
    return simulate.items(spark, sf).select("doc_id", *[v.alias(k) for k, v in datasets.metadata_fields().items()])


def _specimens(spark, sf, dealt) -> DataFrame:
    """The pictures of the mixed rows: every kind of evidence in each."""
    @F.pandas_udf("binary")
    def make(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            rng = np.random.default_rng(int(i) + 7919)
            out.append(inject.specimen(rng.integers(0, 256, (16, 16, 3), dtype=np.uint8), "PNG" if i % 5 == 0 else "JPEG", int(i), rng.bytes(200 + int(i) % 300)))
        return pd.Series(out)

    return dealt(datasets.mixed_rows(_table(spark, sf, "documents"))).withColumn("content", make("doc_id")).withColumn("parts", F.lit("ABCE"))


_vectors: dict = {}
_fitted: dict = {}


def _labelled(spark, sf, part) -> DataFrame:
    """Vectors with split and label, kept for the session: of the pictures to learn from ("train"), of the other pictures
    ("held out"), or of the mixed rows ("mixed").  Parsing pictures takes longest, so each part is made when it is asked for.
    """
    key = (spark.sparkContext.applicationId, sf, part)
    if key not in _vectors:
        dealt = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        if part == "mixed":
            own = _specimens(spark, sf, dealt)
            tokens = datasets.ocr_tokens(own.select("doc_id", "parts"), "mixed_", 1)
        else:
            learned = F.col("split") == "train"
            own = simulate.stratified_split(simulate.items(spark, sf)).where(learned if part == "train" else ~learned)
            own = _with_content(dealt(own))
            tokens = datasets.ocr_tokens(simulate.items(spark, sf))
        kept = ["split", "risk_label"]
        vectors = vector.feature_vector(own.select("image_id", "filename", "caption", "animal", "content", *kept), tokens, kept)
        _vectors[key] = scratch.written(vectors, "vectors")
    return _vectors[key]


def _fit(spark, sf):
    """The model of a folder of tables: fitted once a session, as a service keeps its predictor."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = models.train(_labelled(spark, sf, "train"), C.FEATURES, trees=TREES)
    return _fitted[key]


@query
def gbt_train_eval(spark, sf):
    """Trees of depth 5 on the 47 columns, measured per split and on the mixed rows."""
    model = _fit(spark, sf)
    rows = _labelled(spark, sf, "train").unionByName(_labelled(spark, sf, "held out")).unionByName(_labelled(spark, sf, "mixed"))
    return models.evaluate(model, rows)


@query
def importance_topk(spark, sf):
    """The ten columns that matter most to the model."""
    top = models.importances(_fit(spark, sf))[:10]
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(top)], "place int, column string, importance double")


@query
def analyse_with_model(spark, sf):
    """Decision per item with the fitted model's probability."""
    model = _fit(spark, sf)
    rows = _labelled(spark, sf, "train").unionByName(_labelled(spark, sf, "held out"))
    own = simulate.bundle(spark, sf).withColumn("image_id", F.concat(F.lit("img_"), F.col("doc_id").cast("string")))
    out = analyse.analyse(rows, own, model)
    return out.select("doc_id", "filename", "decision", *[F.round(c, 6).alias(c) for c in ("risk_score", "signal_score", "p")])


@query
def analysis_view(spark, sf):
    """The report of each item, its grid and findings joined to text."""
    own = views.analysis_view(_scored(spark, sf), policy.factors())
    grid = F.array_join(F.array(*[F.concat(F.lit(k + "="), F.element_at("grid", k)) for k in policy.category_scores()]), ",")
    return own.select("doc_id", "decision", F.round("ring", 8).alias("ring"), grid.alias("grid"), F.array_join("factors", "|").alias("factors"), "sanitize_now", "ask")


def queries() -> dict:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _registry}
