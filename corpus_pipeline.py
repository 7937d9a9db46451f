"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; run() writes each stage's rows as Parquet and reads them for the next.
The last stage's rows are the mix: the columns of documents, the words taken
and the epochs of each document that takes part.

In every stage docs has the columns of documents (doc_id, text, lang, source,
n_chars); others are left out, whatever their names. Nulls in any of them are
carried. A null, empty or blank text is no reason for a document to go, but it
gives the mix no words. Texts of any length are worked on whole, each within
one row. No rows give no rows. What ties and repeated rows do is said at each
stage.
"""

from pyspark.sql import functions as F

from codequarry.llm.common import TEXTS_A_TASK, few, materialize, stored, table
from codequarry.llm.decontaminate import decontaminate
from codequarry.llm.line_dedup import line_dedup
from codequarry.llm.ngram_join import ngram_join
from codequarry.llm.source_mixing import mix_sources
from codequarry.llm.toxicity import score_toxicity

REST = ("lang", "source", "n_chars")
COLUMNS = ("doc_id", "text", *REST)


def text_hash(docs):
    return F.xxhash64(docs.text.cast("binary"))


def toxicity(spark, docs, sf_dir):
    """Documents that are predicted toxic go, every row of an id and text alike; scores at the threshold count as toxic."""
    found = score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    toxic = found.select(F.col("doc_id").alias("bad"), F.col("text_hash").alias("hash")).distinct()
    toxic = materialize(few(toxic, docs.count()), "toxic")
    return docs.select(*COLUMNS).join(toxic, docs.doc_id.eqNullSafe(toxic.bad) & (text_hash(docs) == toxic["hash"]), "left_anti")


def lines(spark, docs, sf_dir):
    """Repeated runs of lines go, the first by id, text hash and place stays; rows of one id and text count as one.

    A document goes when nothing but blank lines is left of it and some went.
    """
    found = line_dedup(docs, keep=REST).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("kept.n_chars"))
    return few(found.select("doc_id", "text", "kept.lang", "kept.source", n_chars.alias("n_chars")), docs.count(), TEXTS_A_TASK)


def near_copies(spark, docs, sf_dir):
    """Of each class of near copies one row stays: the smallest id (null last), then the smallest text hash.

    Rows without a set (no words) are classes of their own; of rows that repeat
    an id and text one stays, with the smallest of the other columns.
    """
    found = ngram_join(docs).groupBy("class_set", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "text_hash", "n").alias("row")
    n_docs = docs.count()
    found = materialize(few(found.select("class_set", row), n_docs), "rows")
    ones = found.where("class_set is not null").groupBy("class_set").agg(F.min("row").alias("row")).select("row")
    first = ones.union(found.where("class_set is null").select("row"))
    first = first.select(F.col("row.doc_id").alias("first"), F.col("row.text_hash").alias("hash"), F.col("row.n").alias("n"))
    first = materialize(few(first, n_docs), "first")
    docs = docs.select(*COLUMNS)
    kept = docs.join(first, docs.doc_id.eqNullSafe(first["first"]) & (text_hash(docs) == first["hash"]), "left_semi")
    kept = few(kept, n_docs, TEXTS_A_TASK)
    if first.where("n > 1").isEmpty():
        return kept
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct(*REST)).alias("rest")).select("doc_id", "text", "rest.*")


def benchmark(spark, docs, sf_dir):
    """Documents that give a benchmark item away go, every row of an id and text alike; a coverage at the threshold is enough."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=REST)
    return found.where("not contaminated").select("doc_id", "text", "kept.*")


def mix(spark, docs, sf_dir):
    """Documents of which the mix takes words, with how many; rows of one id and text take as many each."""
    found = mix_sources(docs, keep=("text", *REST))
    return found.where("taken > 0").select("doc_id", "kept.*", "size", "taken", "epochs")


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram join", near_copies), ("decontamination", benchmark), ("mixing", mix)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
