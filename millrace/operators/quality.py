"""Constraints, validation, schema compatibility and critics of extracted graphs.

Critics take entities(ontology_id, id, type, text, properties map, confidence) and relationships(ontology_id,
source_id, target_id, type) and score each ontology in one grouped pass, rounded to four digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.shared import write_table

# ---- fixed values ------------------------------------------------------------------------------------
GENERIC_RELATIONS = ("relates_to", "related_to", "links", "connected", "associated", "rel")
MEANINGFUL_PARTS = ("has_", "is_", "contains_", "performs_", "implements_", "manages_", "causes_", "affects_", "depends_on", "requires_", "uses_", "provides_")
AFFINITY = {
    "manages": ("person", "organization", "manager", "team", "department"),
    "located_in": ("location", "place", "address", "city", "region"),
    "has_symptom": ("patient", "person", "condition", "disease"),
    "implements": ("component", "module", "service", "interface", "class"),
    "part_of": ("component", "organization", "location", "structure"),
}
VOCABULARY = {
    "legal": ("obligation", "party", "contract", "clause", "breach", "liability", "penalty", "jurisdiction", "provision", "agreement"),
    "medical": ("patient", "diagnosis", "treatment", "symptom", "medication", "procedure", "physician", "condition", "dosage", "outcome"),
    "technical": ("component", "service", "api", "endpoint", "module", "interface", "dependency", "version", "protocol", "event"),
    "financial": ("asset", "liability", "transaction", "account", "balance", "payment", "interest", "principal", "collateral", "risk"),
    "general": ("person", "organization", "location", "date", "event", "concept", "action", "property", "relation", "category"),
}
HIERARCHY = ("is_a", "part_of")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _score(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 4)


# ---- validation ---------------------------------------------------------------------------------------
def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """completeness: share of cells neither null nor empty; warn below 0.8."""
    filled = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in columns]
    out = df.agg((F.sum(reduce(lambda a, b: a + b, filled)) / (F.count("*") * len(columns))).alias("completeness"))
    return out.withColumn("warn", F.col("completeness") < 0.8)


def text_quality(text: Column) -> Column:
    """1, less 0.3 below ten characters, less 0.1 if all upper or all lower case."""
    letters = text.rlike(r"\p{L}")
    flat = letters & ((text == F.upper(text)) | (text == F.lower(text)))
    return F.round(1.0 - F.when(F.length(text) < 10, 0.3).otherwise(0.0) - F.when(flat, 0.1).otherwise(0.0), 4)


def length_within(text: Column, low: int, high: int) -> Column:
    """Both bounds inclusive."""
    return F.length(text).between(low, high)


def violations(df: DataFrame, key: str, exists: tuple[str, ...] = (), types: dict[str, str] | None = None, unique: tuple[str, ...] = (), custom: dict[str, Column] | None = None) -> DataFrame:
    """constraint, id, message of each breach; ``custom`` maps a name to a column that gives a message or null."""
    id_ = F.col(key).cast("string").alias("id")
    parts = [df.filter(F.col(c).isNull()).select(F.lit(f"exists:{c}").alias("constraint"), id_, F.lit(f"{c} is missing").alias("message")) for c in exists]
    parts += [df.filter(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull()).select(F.lit(f"type:{c}").alias("constraint"), id_, F.lit(f"{c} is no {t}").alias("message")) for c, t in (types or {}).items()]
    for c in unique:
        twice = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n")).filter("__n > 1")
        parts.append(df.join(twice, c, "left_semi").select(F.lit(f"unique:{c}").alias("constraint"), id_, F.lit(f"{c} isn't unique").alias("message")))
    parts += [df.select(F.lit(f"custom:{n}").alias("constraint"), id_, c.alias("message")).filter("message is not null") for n, c in (custom or {}).items()]
    return reduce(DataFrame.union, parts)


def schema_compatibility(n_unsupported: int, n_labels: int, n_types: int) -> dict[str, object]:
    """100 less 5 for each unsupported index or constraint; compatible from 85; warnings above 100 labels or types."""
    score = max(0, 100 - 5 * n_unsupported)
    return {"score": score, "compatible": score >= 85, "warnings": [w for w, n in (("many labels", n_labels), ("many relationship types", n_types)) if n > 100]}


def drop_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with reason: the first rule that holds, null for rows to keep."""
    out = None
    for name, c in rules.items():
        out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
    return df.withColumn("reason", out)


def error_summary(df: DataFrame, flags: list[str], severity: str = "severity", critical: int = 4) -> DataFrame:
    """error, n, n_critical by flag column, by name."""
    rows = F.array(*(F.struct(F.lit(c).alias("error"), F.col(c).isNotNull().alias("hit")) for c in flags))
    long = df.select(F.col(severity).alias("s"), F.explode(rows).alias("x")).filter("x.hit")
    return long.groupBy(F.col("x.error").alias("error")).agg(F.count("*").alias("n"), F.count_if(F.col("s") >= critical).alias("n_critical"))


def error_patterns(logs: DataFrame, rules: dict[str, str], least: int = 2, top: int = 5) -> DataFrame:
    """logs(id, line) -> pattern, n, percent (of all lines), examples (3 of at most 200 characters): a line may show several."""
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules.items())))
    total = logs.count()
    found = logs.select("id", "line", F.explode(hits).alias("pattern"))
    ranked = found.withColumn("rn", F.row_number().over(W.partitionBy("pattern").orderBy("id")))
    examples = ranked.filter("rn <= 3").groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.left("line", F.lit(200)).alias("line")))), lambda x: x["line"]).alias("examples"))
    counts = found.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(examples, "pattern").select("pattern", "n", F.round(100.0 * F.col("n") / max(total, 1), 2).alias("percent"), "examples").orderBy(F.desc("n"), "pattern").limit(top)


# ---- scores of texts -------------------------------------------------------------------------------------
def keyword_count(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, whatever the case."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words], F.lit(0))


def risk_level(complaints: Column, binding: Column, provisions: Column, high: Column, medium: Column) -> Column:
    """0 to 3 from keyword and provision counts."""
    severe = (high > 0) & (provisions > 0) & (binding > 0)
    many = (complaints > 5) & (binding > 2) & (provisions > 3)
    return F.when(severe | many, 3).when((((complaints > 0) | (medium > 0)) & (binding > 0)) | (provisions > 5), 2).when((complaints > 0) | (provisions > 0), 1).otherwise(0)


def field_relevance(terms: list[str], fields: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, matched terms in order): each field's number of terms among its tokens times its weight."""
    from millrace.functions.text import tokens

    wanted = F.array(*(F.lit(t) for t in terms))
    score, matched = F.lit(0.0), F.array().cast("array<string>")
    for text, weight in fields.values():
        hit = F.array_intersect(wanted, tokens(F.coalesce(text, F.lit(""))))
        score, matched = score + F.size(hit) * weight, F.array_union(matched, hit)
    return score, matched


# ---- critics ---------------------------------------------------------------------------------------------------

def critic_completeness(entities: DataFrame, relationships: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Numbers of entities (10), relationships per entity (1) and types (3), entities without any relationship, and those found in sources(ontology_id, source)."""
    e = entities.groupBy("ontology_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("type") != "", F.col("type"))).alias("types"), F.countDistinct("id").alias("ids"))
    r = relationships.groupBy("ontology_id").agg(F.count("*").alias("rels"))
    ends = relationships.select("ontology_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    lone = entities.select("ontology_id", "id").distinct().join(ends, ["ontology_id", "id"], "left_anti").groupBy("ontology_id").agg(F.count("*").alias("lone"))
    j = e.join(r, "ontology_id", "left").join(lone, "ontology_id", "left").fillna(0, ["rels", "lone"])
    count, density = F.least(F.col("n") / 10.0, F.lit(1.0)), F.least(F.col("rels") / F.col("n"), F.lit(1.0))
    kinds, linked = F.least(F.col("types") / 3.0, F.lit(1.0)), 1.0 - F.col("lone") / F.greatest(F.col("ids"), F.lit(1))
    plain = 0.3 * count + 0.3 * density + 0.2 * kinds + 0.2 * linked
    if sources is None:
        return j.select("ontology_id", _score(plain).alias("completeness"))
    text = F.lower(F.coalesce("text", F.lit("")))
    found = entities.join(sources, "ontology_id").groupBy("ontology_id").agg(F.count_if((text != "") & F.lower("source").contains(text)).alias("found"), F.max(F.length("source")).alias("long"))
    j = j.join(found, "ontology_id", "left")
    full = 0.25 * count + 0.25 * density + 0.15 * kinds + 0.15 * linked + 0.2 * F.col("found") / F.col("n")
    return j.select("ontology_id", _score(F.when(F.col("long") > 0, full).otherwise(plain)).alias("completeness"))


def cyclic(relationships: DataFrame, types: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """ontology_id of those whose edges of the types form a cycle: leaves are stripped until nothing changes."""
    now = write_table(relationships.filter(F.col("type").isin(*types) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("ontology_id", "source_id", "target_id").distinct(), "cycle")
    n = now.count()
    while n:
        inner = now.select("ontology_id", F.col("source_id").alias("target_id")).distinct()
        outer = now.select("ontology_id", F.col("target_id").alias("source_id")).distinct()
        now = write_table(now.join(inner, ["ontology_id", "target_id"], "left_semi").join(outer, ["ontology_id", "source_id"], "left_semi").select("ontology_id", "source_id", "target_id"), "cycle")
        if (m := now.count()) == n:
            break
        n = m
    return now.select("ontology_id").distinct()


def critic_consistency(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Ends that exist (0.5), ids that aren't repeated (0.3), no cycle among is_a and part_of (0.2, of which a cycle takes 15 %)."""
    ids = entities.filter(F.col("id").isNotNull() & (F.col("id") != "")).select("ontology_id", "id")
    dup = ids.groupBy("ontology_id").agg(F.count("*").alias("all"), F.countDistinct("id").alias("kinds"))
    ends = relationships.select("ontology_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    known = ids.distinct().withColumn("known", F.lit(1))
    refs = ends.join(known, ["ontology_id", "id"], "left").groupBy("ontology_id").agg(F.count("*").alias("slots"), F.count_if(F.col("known").isNull()).alias("lost"))
    loops = cyclic(relationships).withColumn("loop", F.lit(1))
    base = entities.select("ontology_id").union(relationships.select("ontology_id")).distinct()
    j = base.join(dup, "ontology_id", "left").join(refs, "ontology_id", "left").join(loops, "ontology_id", "left").fillna(0)
    ref = F.when(F.col("slots") == 0, 1.0).otherwise(1.0 - F.col("lost") / F.col("slots"))
    once = 1.0 - (F.col("all") - F.col("kinds")) / F.greatest(F.col("all"), F.lit(1))
    return j.select("ontology_id", _score(0.5 * ref + 0.3 * once + 0.2 * (1.0 - 0.15 * F.col("loop"))).alias("consistency"))


def critic_coherence(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Names of relationship types (0.35), no loops (0.2), variety of types (0.25), types that suit their ends (0.2). Without relationships 0.3."""
    types = entities.filter(F.col("id").isNotNull()).groupBy("ontology_id", "id").agg(F.lower(F.coalesce(F.last("type"), F.lit(""))).alias("t"))
    ends = lambda side: types.select("ontology_id", F.col("id").alias(f"{side}_id"), F.col("t").alias(f"{side}_type"))
    r = relationships.join(ends("source"), ["ontology_id", "source_id"], "left").join(ends("target"), ["ontology_id", "target_id"], "left")
    low = F.lower(F.coalesce("type", F.lit("")))
    specific = (F.length(low) > 3) & ~low.isin(*GENERIC_RELATIONS)
    meaningful = specific & _any([low.contains(p) for p in MEANINGFUL_PARTS])
    s, t = F.coalesce("source_type", F.lit("")), F.coalesce("target_type", F.lit(""))
    suits = [low.contains(p) & _any([s.contains(x) | t.contains(x) for x in kinds]) for p, kinds in AFFINITY.items()]
    named = _any([low.contains(p) for p in AFFINITY])
    whole = (low != "") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    # A type that suits one pattern counts whole; where no pattern is settled, a half.
    coherent = F.when(~whole, 0.0).when(_any(suits), 1.0).otherwise(0.5)
    agg = r.groupBy("ontology_id").agg(F.count("*").alias("n"), F.count_if(meaningful).alias("m"), F.count_if(specific).alias("sp"), F.count_if(~F.col("source_id").eqNullSafe(F.col("target_id"))).alias("d"), F.countDistinct(F.when(F.col("type") != "", F.col("type"))).alias("k"), F.sum(coherent).alias("c"), F.count_if(named).alias("named"))
    wanted = F.when(F.col("n") < 5, 2.0).when(F.col("n") < 10, 3.0).otherwise(5.0)
    score = 0.35 * (0.7 * F.col("m") + 0.3 * F.col("sp")) / F.col("n") + 0.2 * F.col("d") / F.col("n") + 0.25 * F.least(F.col("k") / wanted, F.lit(1.0)) + 0.2 * F.col("c") / F.col("n")
    base = entities.select("ontology_id").union(relationships.select("ontology_id")).distinct()
    return base.join(agg, "ontology_id", "left").select("ontology_id", F.when(F.col("n") > 0, _score(score)).otherwise(0.3).alias("coherence"))


def critic_clarity(entities: DataFrame) -> DataFrame:
    """Properties (0.3), one naming style (0.2), texts (0.2), confidences (0.2), less short names (0.1)."""
    name = F.coalesce(F.nullif("text", F.lit("")), F.col("id"), F.lit(""))
    styles = [F.count_if(name.rlike(p)) for p in ("^[a-z][a-zA-Z0-9]*$", "^[a-z][a-z0-9_]*$", "^[A-Z][a-zA-Z0-9]*$")]
    n = F.count("*")
    score = 0.3 * F.count_if(F.size("properties") > 0) / n + 0.2 * F.greatest(*styles) / n + 0.2 * F.count_if(F.col("text") != "") / n + 0.2 * F.count_if(F.col("confidence") > 0) / n - 0.1 * F.count_if(F.length(F.trim(name)) < 3) / n
    return entities.groupBy("ontology_id").agg(_score(score).alias("clarity"))


def critic_granularity(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Properties an entity (3 wanted, 0.45), relationships an entity (1.5 wanted, 0.4), less 0.3 of entities without properties."""
    props = F.greatest(F.coalesce(F.size("properties"), F.lit(0)), F.lit(0))
    e = entities.groupBy("ontology_id").agg(F.count("*").alias("n"), F.avg(props).alias("p"), F.count_if(props == 0).alias("bare"))
    j = e.join(relationships.groupBy("ontology_id").agg(F.count("*").alias("r")), "ontology_id", "left").fillna(0, ["r"])
    score = 0.45 * F.least(F.col("p") / 3.0, F.lit(1.0)) + 0.4 * F.least(F.col("r") / F.col("n") / 1.5, F.lit(1.0)) - 0.3 * F.col("bare") / F.col("n")
    return j.select("ontology_id", _score(score).alias("granularity"))


def critic_alignment(entities: DataFrame, relationships: DataFrame, domain: str = "general") -> DataFrame:
    """Share of entity and relationship types that contain, or are part of, a word of the domain."""
    vocab = VOCABULARY.get(domain.lower(), VOCABULARY["general"])
    terms = entities.select("ontology_id", F.lower(F.coalesce("type", F.lit(""))).alias("t")).union(relationships.select("ontology_id", F.lower(F.coalesce("type", F.lit("")))))
    hit = _any([F.col("t").contains(v) | F.lit(v).contains(F.col("t")) for v in vocab])
    return terms.groupBy("ontology_id").agg(_score(F.count_if(hit) / F.count("*")).alias("alignment"))


def rank_by(scores: DataFrame, column: str = "overall", index: str = "ontology_id") -> DataFrame:
    """scores with rank from 1; equal ones in order of index. A ranking of whole results is small beside its inputs."""
    from millrace.operators.stats import global_rank

    return global_rank(scores.withColumn("__neg", -F.col(column)), "__neg", index).drop("__neg")


def reweight(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over positive weights; 0.5 if there are none."""
    used = {k: w for k, w in weights.items() if w > 0 and k in values}
    if not used:
        return F.lit(0.5)
    return reduce(lambda a, b: a + b, [values[k] * w for k, w in used.items()]) / sum(used.values())


def against_baseline(value: Column, base: Column) -> Column:
    """Percent above the baseline; null for a baseline of 0."""
    return F.try_divide((value - base) * 100.0, base)


def trend(df: DataFrame, key: str, order: str, value: str, threshold: float = 0.01) -> DataFrame:
    """key, change from first to last, and improving, degrading or stable beyond ``threshold`` a step."""
    s = df.groupBy(key).agg((F.max_by(value, order) - F.min_by(value, order)).alias("change"), F.count("*").alias("n"))
    edge = threshold * F.col("n")
    return s.select(key, "change", F.when(F.col("change") > edge, "improving").when(F.col("change") < -edge, "degrading").otherwise("stable").alias("trend"))


def sorted_entities(entities: DataFrame) -> DataFrame:
    """entities with place, from 1 in order of id, type, text and falling confidence in each ontology."""
    w = W.partitionBy("ontology_id").orderBy("id", "type", "text", F.desc("confidence"))
    return entities.withColumn("place", F.row_number().over(w))
