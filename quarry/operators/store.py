"""A stored inverted index: postings, documents and terms as Parquet, read by term.

A folder holds generations. Each has ``docs`` (the columns of doc_info, without text), ``postings`` (field, term, doc_id,
wdf, positions, dl) and ``terms`` (field, term, df, cf). Postings and terms lie in folders by a hash of a term's first two
characters and are sorted by term inside, so that a search lists a few folders and skips most row groups of their files. A
folder is written by as many tasks as there are shuffle partitions for it, and a frequent term spreads over them by blocks
of doc_id. An update writes a generation and the
ids that it replaces; compact() folds all into one. Nothing that a search reads holds a text.

Fields: ``body`` and ``title`` hold the terms as they are, ``path`` words of the URL; ``plain`` terms without their accents,
``part`` the components of dotted terms, ``cjkv`` the unigrams and bigrams of scripts without spaces, ``stem`` the stems of
documents in a language that has a stemmer. A variant stands at the position of its term.

Defined cases: null texts and titles have no terms; doc_ids are unique (the last update of one holds); very long texts
are indexed whole; an empty table makes an index without documents; an empty query is an error.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import language as la
from quarry.functions import text as tx
from quarry.functions.extract import LENGTH
from quarry.functions.url import canonical
from quarry.operators.index import B, K1
from quarry.plans import query as qp

BUCKETS = 64
SCHEMAS = {"postings": "field string, term string, doc_id long, wdf int, positions array<int>, dl int, bucket int", "terms": "field string, term string, df long, cf long, bucket int"}
FIELDS = ["body", "title", "path", "plain", "part", "cjkv", "stem"]
#: Where a word of a query is looked for: as it stands, or among the variants too.
EXACT, VARIANTS = ["body"], ["body", "title", "plain", "part", "cjkv"]


def bucket(term: Column) -> Column:
    return (F.crc32(F.encode(F.substring(term, 1, 2), "UTF-8")) % BUCKETS).cast("int")


def bucket_of(term: str) -> int:
    return zlib.crc32(term[:2].encode()) % BUCKETS


@functools.lru_cache(1 << 18)
def _plain(term: str) -> str:
    return qp.plain(term)


@functools.lru_cache(1 << 18)
def _stem(term: str) -> str:
    return la.stem_word(term)


@F.pandas_udf(StringType())
def plain_terms(terms: pd.Series) -> pd.Series:
    """Without accents; worker caches, as terms repeat."""
    return terms.map(_plain, na_action="ignore")


@F.pandas_udf(StringType())
def stem_terms(terms: pd.Series) -> pd.Series:
    return terms.map(_stem, na_action="ignore")


def runs(df: DataFrame, tokens: Column, keep: list[str]) -> DataFrame:
    """One row a distinct term of each row: term, positions, dl beside the columns kept. Terms are grouped inside the row:
    sorted with their positions and cut where the term changes, so that nothing is shuffled."""
    t = df.select(*keep, F.transform(tokens, lambda x, i: F.struct(x.alias("term"), i.alias("pos"))).alias("_t"))
    t = t.withColumn("_t", F.sort_array("_t")).withColumn("dl", F.size("_t"))
    starts = F.filter(F.transform("_t", lambda x, i: F.when((i == 0) | (F.get(F.col("_t"), i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
    t = t.withColumn("_s", starts)
    cut = lambda s, k: F.struct(F.get(F.col("_t"), s)["term"].alias("term"), F.slice("_t", s + 1, F.coalesce(F.get(F.col("_s"), k + 1), F.col("dl")) - s)["pos"].alias("positions"))
    return t.select(*keep, "dl", F.explode(F.transform("_s", cut)).alias("_x")).select(*keep, "dl", "_x.term", "_x.positions")


def postings(docs: DataFrame) -> DataFrame:
    """field, term, doc_id, wdf, positions, dl of documents with title, url, language and text."""
    cols = ["doc_id", "language"]
    own = lambda field, tokens: runs(docs, tokens, cols).withColumn("field", F.lit(field))
    body = own("body", tx.tokens(F.col("text")))
    whole = body.unionByName(own("title", tx.tokens(F.col("title")))).unionByName(own("path", tx.tokens(F.replace("url", F.lit("."), F.lit(" ")))))
    # variants come from the terms of bodies, at most a few a term
    odd, dotted = body.filter(F.col("term").rlike(r"[^\x00-\x7F]")), body.filter(F.contains("term", F.lit(".")))
    plain = odd.filter(~tx.has_cjkv(F.col("term"))).withColumn("plain", plain_terms("term")).filter("plain != term AND plain != ''").withColumn("term", F.col("plain")).drop("plain")
    grams = odd.filter(tx.has_cjkv(F.col("term"))).withColumn("term", F.explode(tx.cjkv_grams(F.col("term"))))
    parts = dotted.withColumn("term", F.explode(F.array_distinct(F.filter(F.split("term", r"\."), lambda x: x != ""))))
    stems = body.filter(F.col("language").isin(*la.STEMMABLE) & ~F.col("term").rlike("^[0-9]")).withColumn("term", stem_terms("term"))
    for field, rows in (("plain", plain), ("cjkv", grams), ("part", parts), ("stem", stems)):
        whole = whole.unionByName(rows.withColumn("field", F.lit(field)))
    return whole.select("field", "term", "doc_id", F.size("positions").alias("wdf"), "positions", "dl")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class StoredIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, generations: list[str] = (), gone: list[str] = ()):
        self.spark, self.path, self.generations, self.gone = spark, path.rstrip("/"), list(generations), list(gone)

    # writing

    def _write(self, docs: DataFrame) -> str:
        name = uuid.uuid4().hex
        to = f"{self.path}/{name}"
        docs.withColumn("has_cjkv", tx.has_cjkv(F.col("text"))).withColumn("sample", F.substring("text", 1, LENGTH)).drop("text").write.parquet(f"{to}/docs")
        self._write_terms(postings(docs), to)
        return name

    def _write_terms(self, p: DataFrame, to: str) -> None:
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        p = p.withColumn("bucket", bucket(F.col("term")))
        salt = F.pmod(F.xxhash64("term", F.shiftright("doc_id", 16)), F.lit(salts))
        p.repartition("bucket", salt).sortWithinPartitions("bucket", "field", "term", "doc_id").write.partitionBy("bucket").parquet(f"{to}/postings")
        t = self._read(f"{to}/postings").groupBy("bucket", "field", "term").agg(F.count("*").alias("df"), F.sum("wdf").alias("cf"))
        t.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(salts))).sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{to}/terms")

    def _read(self, path: str) -> DataFrame:
        schema = SCHEMAS.get(path.rsplit("/", 1)[1])
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)

    def add(self, docs: DataFrame) -> StoredIndex:
        """With more documents, which replace those of the same ids. docs: doc_info() columns, text included."""
        if not self.generations:
            return StoredIndex(self.spark, self.path, [self._write(docs)])
        return self._without(docs.select("doc_id"))._with(self._write(docs))

    def _with(self, name: str) -> StoredIndex:
        return StoredIndex(self.spark, self.path, [*self.generations, name], [*self.gone, *[""] * (len(self.generations) + 1 - len(self.gone))])

    def _without(self, ids: DataFrame) -> StoredIndex:
        """gone[k] lists folders with ids that generation k no longer has."""
        to = f"{self.path}/gone-{uuid.uuid4().hex}"
        ids.select("doc_id").distinct().write.parquet(to)
        gone = [*self.gone, *[""] * (len(self.generations) - len(self.gone))]
        return StoredIndex(self.spark, self.path, self.generations, [f"{g},{to}".strip(",") for g in gone])

    def unindex(self, where: Column) -> StoredIndex:
        """Without the documents of which a condition on their columns holds (id, URL, label, directory, file ...)."""
        return self._without(self.docs().filter(where))

    def update_properties(self, where: Column, **columns: Column) -> StoredIndex:
        """With other values in the columns of some documents; postings and terms stay as they are."""
        changed = self.docs()
        for name, value in columns.items():
            changed = changed.withColumn(name, F.when(where, value).otherwise(F.col(name)))
        return self._rewritten(changed, self.postings())

    def compact(self) -> StoredIndex:
        """One generation with what all of them hold; the old ones are left to readers until drop()."""
        return self._rewritten(self.docs(), self.postings())

    def _rewritten(self, docs: DataFrame, p: DataFrame) -> StoredIndex:
        name = uuid.uuid4().hex
        to = f"{self.path}/{name}"
        docs.write.parquet(f"{to}/docs")
        self._write_terms(p, to)
        return StoredIndex(self.spark, self.path, [name])

    def merged(self, other: StoredIndex, path: str) -> StoredIndex:
        """A new index of both: documents of the first get odd ids, those of the second even ones, in their order."""
        renumber = lambda df, k: df.withColumn("doc_id", F.col("doc_id") * 2 - k)
        both = lambda a, b: renumber(a, 1).unionByName(renumber(b, 0), allowMissingColumns=True)
        return StoredIndex(self.spark, path)._rewritten(both(self.docs(), other.docs()), both(self.postings(), other.postings()))

    def drop(self) -> None:
        _delete(self.spark, self.path)

    # reading

    def _all(self, kind: str) -> DataFrame:
        parts = []
        for k, name in enumerate(self.generations):
            df = self._read(f"{self.path}/{name}/{kind}")
            for folder in filter(None, self.gone[k].split(",") if k < len(self.gone) else []):
                df = df.join(self._read(folder), "doc_id", "left_anti")
            parts.append(df)
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def docs(self) -> DataFrame:
        return self._all("docs")

    def postings(self) -> DataFrame:
        """field, term, doc_id, wdf, positions, dl."""
        return self._all("postings").drop("bucket")

    def terms(self) -> DataFrame:
        """field, term, df, cf: as stored, or counted anew while some generation lacks documents or there are several."""
        if len(self.generations) == 1 and not any(self.gone):
            return self._read(f"{self.path}/{self.generations[0]}/terms").drop("bucket")
        return self.postings().groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("wdf").alias("cf"))

    def wanted(self, words: list[str], prefixes: list[str] = (), fields: list[str] = EXACT, kind: str = "postings") -> DataFrame:
        """The rows of some terms: folders are chosen by their first two letters, row groups by the terms."""
        rows, held = self._all(kind), F.lit(False)
        if words:
            held |= F.col("term").isin(sorted(set(words)))
        for p in prefixes:
            held |= F.col("term").startswith(p)
        if all(len(p) > 1 for p in prefixes):
            rows = rows.filter(F.col("bucket").isin(sorted({bucket_of(x) for x in [*words, *prefixes]})))
        return rows.filter(F.col("field").isin(list(fields)) & held).drop("bucket")

    def size(self) -> tuple[int, float]:
        """Number of documents and their mean length in terms."""
        if not hasattr(self, "_size"):
            n = self.docs().count()
            total = self._read_lengths()
            self._size = (n, total / n if n else 0.0)
        return self._size

    def _read_lengths(self) -> int:
        if len(self.generations) == 1 and not any(self.gone):
            t = self._read(f"{self.path}/{self.generations[0]}/terms").filter("field = 'body'").agg(F.sum("cf")).first()[0]
        else:
            t = self._all("postings").filter("field = 'body'").agg(F.sum("wdf")).first()[0]
        return t or 0

    def bm25(self, words: list[str], every: bool = True) -> DataFrame:
        """doc_id, score of the documents with every (or any) word, from the words' postings alone."""
        words = sorted(set(words))
        n, mean = self.size()
        p = self.wanted(words).select("term", "doc_id", "wdf", "dl")
        df = {r[0]: r[1] for r in self.wanted(words, kind="terms").select("term", "df").collect()} if self._whole() else {r[0]: r[1] for r in p.groupBy("term").count().collect()}
        weight = F.lit(0.0)
        for w in words:
            weight = F.when(F.col("term") == w, F.log((F.lit(float(n)) - df.get(w, 0) + 0.5) / (F.lit(df.get(w, 0)) + 0.5) + 1)).otherwise(weight)
        part = weight * F.col("wdf") * (K1 + 1) / (F.col("wdf") + K1 * ((1 - B) + B * F.col("dl") / F.lit(mean or 1.0)))
        scored = p.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("_n"))
        return scored.filter(F.col("_n") >= (len(words) if every else 1)).drop("_n")

    def _whole(self) -> bool:
        return len(self.generations) == 1 and not any(self.gone)

    def match(self, query: str, default: str = "AND", variants: bool = False, stemmed: bool = False, stop: frozenset = frozenset()) -> DataFrame:
        """doc_id of what the query finds. Words are looked up as they stand, or (variants) among titles, unaccented
        terms, parts of dotted terms and n-grams too; stemmed looks for their stems, without stopwords if others are left."""
        return self.found(qp.parse(query, default), variants, stemmed, stop)

    def search(self, query: str, language: str = "", default: str = "AND", stop: frozenset = frozenset()) -> DataFrame:
        """Two steps: the words and their variants; if that finds nothing and the language has a stemmer, stems."""
        first = self.match(query, default, True)
        if language not in la.STEMMABLE or not first.isEmpty():
            return first
        return self.match(query, default, True, True, stop)

    def corrected(self, query: str) -> str:
        """The query with each word that the index lacks replaced by the nearest term of two edits at most (the more frequent
        one of several), if the query as it is finds nothing; else, or without such terms, an empty text."""
        if not self.match(query, variants=True).isEmpty():
            return ""
        words = [n[1].lower() for n in _words(qp.parse(query))]
        known = {r[0] for r in self.wanted(words, fields=["body"], kind="terms").select("term").distinct().collect()}
        out = query
        for w in [w for w in words if w not in known]:
            near = self.terms().filter("field = 'body'").withColumn("d", F.levenshtein("term", F.lit(w), 2)).filter("d > 0")
            best = near.orderBy("d", F.desc("cf"), "term").limit(1).collect()
            if best:
                out = re.sub(rf"(?i)(?<!\w){re.escape(w)}(?!\w)", best[0]["term"], out)
        return "" if out == query else out

    def list_documents(self, where: Column | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        """A page of documents by id; where: a condition on label, directory, file, URL ..."""
        rows = self.docs() if where is None else self.docs().filter(where)
        return rows.orderBy("doc_id").offset(offset).limit(limit)

    def has_document(self, url: str) -> int:
        """The id of a canonical URL's document, 0 if there is none."""
        own = self.docs().filter(canonical(F.col("url")) == canonical(F.lit(url)))
        return own.agg(F.min("doc_id")).first()[0] or 0

    def found(self, node, variants: bool, stemmed: bool, stop: frozenset) -> DataFrame:
        aggs, words, prefixes, fields = [], set(), set(), set()
        if stemmed and stop and len(_words(node)) > 1:
            node = _unstopped(node, stop) or node

        def has(where: Column) -> str:
            name = f"_l{len(aggs)}"
            aggs.append(F.coalesce(F.max(where), F.lit(False)).alias(name))
            return name

        def places(word: str, own: list[str]) -> str:
            name = f"_l{len(aggs)}"
            aggs.append(F.flatten(F.collect_list(F.when((F.col("term") == word) & F.col("field").isin(own), F.col("positions")))).alias(name))
            words.add(word)
            fields.update(own)
            return name

        def one(word: str, own: list[str]) -> Column:
            words.add(word)
            fields.update(own)
            return F.coalesce(F.col(has((F.col("term") == word) & F.col("field").isin(own))), F.lit(False))

        def any_form(word: str) -> Column:
            if variants and qp.has_any_cjkv(word):
                out = F.lit(True)
                for g in qp.grams(word):
                    out &= one(g, ["cjkv"])
                return out
            own = VARIANTS if variants else EXACT
            out = one(word, own)
            if variants and qp.plain(word) != word:
                out |= one(qp.plain(word), own)
            if stemmed:
                out |= one(la.stem_word(qp.plain(word)), ["stem"])
            return out

        def leaf(n) -> Column:
            if n[0] == "prefix":
                p = n[1][:-1].lower()
                own = ["body", "title"] if variants else EXACT
                prefixes.add(p)
                fields.update(own)
                return F.coalesce(F.col(has(F.col("term").startswith(p) & F.col("field").isin(own))), F.lit(False))
            sides = qp.leaf_words(n)
            if not all(sides):
                return F.lit(False)
            if len(sides) == 1 and len(sides[0]) == 1:
                return any_form(sides[0][0])
            at = [[F.col(places(w, EXACT)) for w in x] for x in sides]
            got = qp.next_to(at[0]) if len(at) == 1 else qp.near(at[0], at[1], n[0] == "adj")
            return F.coalesce(got, F.lit(False))

        def words_in(field: str, value: str) -> Column:
            if field == "tokens":
                return F.col("has_cjkv") & F.lit(value == "CJKV")
            out = F.lit(True)
            for w in qp.words_of(value if field == "title" else value.replace(".", " ")):
                out &= one(w, [field])
            return out

        condition = qp.predicate(node, leaf, words_in)
        held = self.wanted(sorted(words), sorted(prefixes), sorted(fields)).groupBy("doc_id").agg(*aggs) if aggs else None
        if held is None:
            found = self.docs()
        elif _needs_all(node):
            found = self.docs().join(held, "doc_id", "left")
        elif _needs_docs(node):
            found = held.join(self.docs(), "doc_id")
        else:
            found = held
        return found.filter(condition).select("doc_id")


def _words(node) -> list:
    if node[0] in ("and", "or"):
        return [w for n in node[1] for w in _words(n)]
    if node[0] == "not":
        return _words(node[1])
    return [node] if node[0] == "word" else []


def _unstopped(node, stop: frozenset):
    """Without single stopwords; None if nothing is left."""
    if node[0] in ("and", "or"):
        kept = [x for n in node[1] if (x := _unstopped(n, stop))]
        return (node[0], kept) if len(kept) > 1 else kept[0] if kept else None
    if node[0] == "word" and node[1].lower() in stop:
        return None
    return node


def _needs_docs(node) -> bool:
    kind = node[0]
    if kind in ("and", "or"):
        return any(_needs_docs(n) for n in node[1])
    if kind == "not":
        return _needs_docs(node[1])
    return kind == "range" or (kind == "filter" and node[1].split(":")[0] not in ("title", "path"))


def _needs_all(node) -> bool:
    """Whether a document without any of the query's words may be found."""
    kind = node[0]
    if kind == "and":
        return all(_needs_all(n) for n in node[1])
    if kind == "or":
        return any(_needs_all(n) for n in node[1])
    return kind in ("not", "range") or (kind == "filter" and node[1].split(":")[0] not in ("title", "path"))


_open: dict[tuple, StoredIndex] = {}


def index_of(spark: SparkSession, name: str, docs) -> StoredIndex:
    """The index of a named set of documents: built once a session in the shared folder, then reread. docs: a function
    that gives the documents."""
    from quarry.sources.shared import shared_dir

    key = (spark.sparkContext.applicationId, name)
    if key not in _open:
        _open[key] = StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").add(docs())
    return _open[key]
