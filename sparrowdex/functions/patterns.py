"""Rules for entities and relations in text, applied natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start and end of a word in ASCII terms; the engine's own \b takes accented letters for word characters.
_A, _Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

#: Fixed values: (type, confidence, pattern), in the order in which rules are tried.
ENTITY_RULES = [
    ("Email", 0.95, _A + r"[\w%+.-]+@[\d.A-Za-z-]+\.[A-Za-z]{2,}" + _Z),
    ("URL", 0.95, r"https?://(?:www\.)?[\w#%+.:=@~-]{1,256}\.[\d()A-Za-z]{1,6}" + _Z + r"(?:[\w#%&()+./:=?@~-]*)"),
    ("Phone", 0.7, r"(?:\+?(?:\d{1,3}))?[ (.-]*(?:\d{3})[ ).-]*(?:\d{3})[ .-]*(?:\d{4})"),
    ("Phone", 0.7, r"\+?\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"),
    ("Date", 0.85, r"(?:\d{1,2}[/-]){2}\d{2,4}"),
    ("Date", 0.85, r"\d{4}(?:[/-]\d{1,2}){2}"),
    ("Date", 0.85, _A + rf"(?i:{_LONG})\s+\d{{1,2}},?\s+\d{{4}}" + _Z),
    ("Date", 0.85, _A + rf"(?i:{_SHORT})\s+\d{{1,2}},?\s+\d{{4}}" + _Z),
    ("Currency", 0.9, r"\$\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"(?i:USD)\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"€\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"(?i:EUR)\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"£\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"(?i:GBP)\s*[\d,]+(?:\.\d{2})?"),
    ("Currency", 0.9, r"(?i:Rp)\.?\s*[\d,.]+"),
    ("Currency", 0.9, r"(?i:IDR)\s*[\d,.]+"),
    ("Number", 0.9, _A + r"\d+(?:\.\d+)?%"),
    ("API", 0.85, r"/api/[\w/-]+"),
    ("Function", 0.7, _A + r"[A-Z_a-z]\w*\s*\(\)"),
    ("Technology", 0.6, _A + r"[A-Z][A-Z0-9_]{2,}" + _Z + r"(?=\s*[=:]|\s+is|\s+set)"),
    ("Error", 0.8, _A + r"(?i:ERR|ERROR|E)[-_]?\d{3,5}" + _Z),
]
#: Words before () that are no functions.
KEYWORDS = "if|for|while|switch|catch"

_W = r"(\w+)"
#: Fixed values: (type, confidence, pattern, whether source and target change places, domain).
RELATION_RULES = [
    ("MENTIONS", 0.7, _W + r"\s+(?:mentions?|refers? to|discusses?)\s+" + _W, False, "universal"),
    ("PART_OF", 0.8, _W + r"\s+(?:is part of|belongs to|in)\s+" + _W, False, "universal"),
    ("CITES", 0.85, _W + r"\s+(?:cites?|references?|according to)\s+" + _W, False, "universal"),
    ("WORKS_FOR", 0.8, _W + r"\s+(?:works? for|employed by|at)\s+" + _W, False, "universal"),
    ("CREATED_BY", 0.8, _W + r"\s+(?:created|developed|built) by\s+" + _W, False, "universal"),
    ("LOCATED_IN", 0.8, _W + r"\s+(?:located in|based in|headquartered in)\s+" + _W, False, "universal"),
    ("IMPLEMENTS", 0.9, r"(pp\s+\S+)\s+(?:implements?|melaksanakan)\s+(uu\s+\S+)", False, "legal"),
    ("REFINES", 0.9, r"(pp\s+\S+)\s+(?:refines?|clarifies?|memperjelas)\s+(uu\s+\S+)", False, "legal"),
    ("SUPERSEDES", 0.9, r"(uu\s+\S+|pp\s+\S+)\s+(?:supersedes?|replaces?|menggantikan)\s+(uu\s+\S+|pp\s+\S+)", False, "legal"),
    ("APPLIES_TO", 0.8, r"(uu\s+\S+|pp\s+\S+)\s+(?:applies to|berlaku untuk)\s+([a-z][\s\w]+)", False, "legal"),
    ("PART_OF", 0.95, r"(pasal\s+\d+)\s+(?:of|dalam|from)\s+(uu\s+\S+|pp\s+\S+)", False, "legal"),
    ("REQUIRES", 0.85, r"(uu\s+\S+|pp\s+\S+)\s+(?:requires?|mewajibkan|mengharuskan)\s+([a-z][\s\w]+)", False, "legal"),
    ("PAYS", 0.85, _W + r"\s+(?:pays?|transfers?)\s+[\d\s$,.prp£€]+ to\s+" + _W, False, "financial"),
    ("OWNED_BY", 0.8, _W + r"\s+(?:owns?|possesses?)\s+" + _W, True, "financial"),
    ("TRANSFERS", 0.8, _W + r"\s+(?:transfers?|sends?)\s+(?:to|ke)\s+" + _W, False, "financial"),
    ("CALLS", 0.9, r"(\w+\(\))\s+calls?\s+(\w+\(\))", False, "technical"),
    ("THROWS", 0.9, r"(\w+\(\))\s+throws?\s+(\w+(?:error|exception))", False, "technical"),
    ("DEPENDS_ON", 0.8, _W + r"\s+(?:depends on|requires?)\s+" + _W, False, "technical"),
    ("RETURNS", 0.85, r"(\w+\(\))\s+returns?\s+(\w+)", False, "technical"),
]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _as_entity(kind: str, confidence: float, k: int):
    return lambda m, i: F.struct(
        F.lit(kind).alias("type"), F.regexp_replace(m, r"^\s+|\s+$", "").alias("name"), F.lit(confidence).alias("confidence"), (F.lit(k * 1_000_000) + i).cast("long").alias("seq")
    )


def _as_relation(kind: str, confidence: float):
    return lambda z: F.struct(z["0"].alias("source"), z["1"].alias("target"), F.lit(kind).alias("rel_type"), F.lit(confidence).alias("confidence"), z["2"].alias("context"))


def entities_of(text: Column, types: list[str] | None = None) -> Column:
    """array of struct(type, name, confidence, seq): all matches of all rules, in the rules' order and then the text's."""
    out = []
    for k, (kind, confidence, pattern) in enumerate(ENTITY_RULES):
        if types and kind not in types:
            continue
        found = matches(text, pattern)
        if kind == "Function":
            found = F.filter(found, lambda m: ~m.rlike(rf"^({KEYWORDS})\s*\(\)$"))
        out.append(F.transform(found, _as_entity(kind, confidence, k)))
    return F.concat(*out)


def extract_entities(docs: DataFrame, *, key: str = "doc_id", text: str = "text", types: list[str] | None = None) -> DataFrame:
    """Rows (key, type, name, confidence, seq); of equal type and name the first stays."""
    rows = docs.select(key, F.explode(entities_of(F.col(text), types)).alias("e")).select(key, "e.*").filter(F.length("name") > 0)
    return rows.groupBy(key, "type", "name").agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq").alias("seq"))


def dedupe_entities(entities: DataFrame, *, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """One entity for each type and lower-case name: that of the highest confidence, the first of equals."""
    best = F.max_by(F.struct(*[c for c in entities.columns if c not in (key, "type")]), F.struct("confidence", -F.col(order)))
    return entities.groupBy(key, "type", F.lower("name").alias("_n")).agg(best.alias("e")).select(key, "type", "e.*").select(*entities.columns)


def merge_entities(entities: DataFrame, *, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """Across chunks: by trimmed lower-case name and type, the first row with the highest confidence of all."""
    keep = [c for c in entities.columns if c not in (key, "type", "confidence")]
    out = entities.groupBy(key, "type", F.lower(F.trim("name")).alias("_n")).agg(F.min_by(F.struct(*keep), order).alias("e"), F.max("confidence").alias("confidence"))
    return out.select(key, "type", "e.*", "confidence").select(*entities.columns)


def relations_of(text: Column, domains: tuple[str, ...] = ("universal", "legal", "financial", "technical")) -> Column:
    """array of struct(source, target, rel_type, confidence, context): all matches of the rules of the domains."""
    out = []
    for kind, confidence, pattern, swapped, domain in RELATION_RULES:
        if domain not in domains:
            continue
        p = "(?i)" + pattern
        a, b = (2, 1) if swapped else (1, 2)
        whole, one, two = matches(text, p, 0), matches(text, p, a), matches(text, p, b)
        zipped = F.arrays_zip(one, two, whole)
        out.append(F.transform(zipped, _as_relation(kind, confidence)))
    return F.concat(*out)


def extract_relations(docs: DataFrame, entities: DataFrame, *, key: str = "doc_id", text: str = "text", domains=("universal", "legal", "financial", "technical")) -> DataFrame:
    """Relations whose two ends are known entities of the document; one for each source, type and target, the most confident.

    A document with fewer than two entities has none.
    """
    found = docs.select(key, F.posexplode(relations_of(F.col(text), domains)).alias("seq", "r")).select(key, "seq", "r.*")
    known = entities.select(key, F.lower("name").alias("_n"), F.col("name").alias("_name"), F.col("seq").alias("_seq"))
    known = known.groupBy(key, "_n").agg(F.min_by("_name", "_seq").alias("_name"))
    enough = known.groupBy(key).agg(F.count("*").alias("_c")).filter("_c >= 2").select(key)
    source = known.withColumnsRenamed({"_n": "_s", "_name": "source_name"})
    target = known.withColumnsRenamed({"_n": "_t", "_name": "target_name"})
    both = (
        found.withColumns({"_s": F.lower("source"), "_t": F.lower("target")})
        .join(enough, key, "left_semi")
        .join(source, [key, "_s"])
        .join(target, [key, "_t"])
        .select(key, F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", "confidence", "context", "seq")
    )
    return dedupe_relations(both, key=key)


def dedupe_relations(relations: DataFrame, *, key: str = "doc_id", order: str = "seq") -> DataFrame:
    rest = [c for c in relations.columns if c not in (key, "source", "target", "rel_type")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col(order)))
    return relations.groupBy(key, "source", "rel_type", "target").agg(best.alias("r")).select(key, "source", "target", "rel_type", "r.*").select(*relations.columns)
