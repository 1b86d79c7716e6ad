"""What a question asks: intent, kind, pattern, terms, specifications, and the bias that its wording gives clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators.procedures import ROLES, TEXT_ROLES, assemble

# Question words of each intent, in the order that settles ties.
FUNCTION_NAMES = ("amf", "smf", "upf", "nrf", "ausf", "udm", "pcf", "nssf", "af", "nef", "sepp", "scp")
INTENTS = {
    "definition": (r"\bwhat is\b", r"\bwhat are\b", r"\bdefine\b", r"\bmeaning of\b", r"\bstand for\b", r"\bacronym\b"),
    "procedure": (r"\bhow does\b", r"\bhow to\b", r"\bsteps\b", r"\bprocess\b", r"\bprocedure\b", r"\bflow\b", r"\bsequence\b"),
    "comparison": (r"\bdifference\b", r"\bcompare\b", r"\bvs\b", r"\bversus\b", r"\bsimilar\b", r"\bdistinguish\b"),
    "reference": (r"\bts\s+\d{2}\.\d{3}\b", r"\bspec\b", r"\bspecification\b", r"\bdocument\b", r"\bclause\b", r"\bsection\b"),
    "relationship": (r"\brelationship\b", r"\binterface\b", r"\binteract\b", r"\bconnect\b", r"\blink\b", r"\bbetween\b.*\band\b"),
}
# The kind of question of each intent; any other is WHAT_DEF.
KINDS = {
    "HOW_PROC": ("procedure", "how_does", "how_to", "mechanism", "call_flow"),
    "WHERE_LOC": ("location", "reference", "which_spec", "interface", "cross_spec"),
    "WHO_ENTITY": ("provider", "which_nf", "entity", "relationship"),
    "WHY_COND": ("reason", "condition", "when", "requirement"),
}
# Names of procedures, titles of general clauses, words of studies, and the weights of the bias.
PROCEDURES = ("registration", "deregistration", "authentication", "handover", "subscription", "selection", "establishment", "modification", "release", "reallocation", "reachability", "configuration update", "service request", "paging", "mobility", "provisioning", "activation", "deactivation")
GENERAL_TITLES = ("general", "overview", "introduction", "definition", "principles")
STUDY_WORDS = ("solution", "key issue", "study", "tr 23", "technical report")
BIAS = {"report": -0.6, "impacts": -0.7, "generic": -0.25, "step_all": 0.7, "step_more": 0.12, "step_cap": 0.36, "op_prefix": 0.4, "anchor": 0.7, "chain": 0.5, "on_topic": 0.5, "off_topic": -0.3}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def intent(question: Column) -> Column:
    """Names of network functions first, then the intent with the most words, ties in order, else general."""
    low = F.lower(question)
    counts = {k: sum((low.rlike(p).cast("int") for p in ps), F.lit(0)) for k, ps in INTENTS.items()}
    most = F.greatest(*counts.values())
    out = F.when(low.rlike(r"\b(" + "|".join(FUNCTION_NAMES) + r")\b"), "network_function").when(most == 0, "general")
    for k, n in counts.items():
        out = out.when(n == most, k)
    return out


def kind(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, names in KINDS.items():
        out = out.when(F.lower(F.trim(name)).isin(*names), k)
    return out.otherwise("WHAT_DEF")


def pattern(wh: Column, n_terms: Column, has_spec: Column, message: Column, parameter: Column, interface: Column) -> Column:
    """The graph pattern: a named message or parameter comes first, then the kind's tree over the number of terms."""
    by_terms = lambda many, one: F.when(n_terms >= 2, many).when(n_terms == 1, one)
    with_interface = lambda c: c.when(interface.isNotNull(), "B").otherwise("C")
    return (
        F.when(message.isNotNull(), "M")
        .when(parameter.isNotNull(), "P")
        .when(wh == "WHAT_DEF", with_interface(by_terms("A2", "FUNC")))
        .when(wh == "HOW_PROC", with_interface(by_terms("FG", "A1")))
        .when(wh == "WHERE_LOC", F.when(has_spec, "E").when(interface.isNotNull(), "B").otherwise(by_terms("A2", "A1").otherwise("C")))
        .when(wh == "WHO_ENTITY", by_terms("FG", "A1").otherwise("C"))
        .when(wh == "WHY_COND", with_interface(by_terms("A2", "A1")))
        .otherwise("C")
    )


#: Most abbreviations and names that are broadcast; beyond it runs of words meet them by shuffle.
BROADCAST_KEYS = 1 << 18


def _named(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, terms): the terms named by each question that names some, as structs of term and matched, by term.

    Runs of one to eight words meet abbreviations and names by equality; what a question's runs hit is one small
    array, in which of names that overlap at a place the longest counts.
    """
    words = questions.select("qid", F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9]+(?:[-_/][a-z0-9]+)*"), 0).alias("w"))
    starts = words.select("qid", "w", F.posexplode("w").alias("at", "_"))
    runs = starts.select("qid", "at", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - F.col("at"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("s")))).alias("r")).select("qid", "at", "r.n", "r.s")
    keys = terms.select("term", F.lower("term").alias("s")).unionByName(terms.select("term", F.lower("full_name").alias("s"))).distinct()
    key = dict(keys.dtypes)["term"]
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys  # runs are many times the questions, and only hits need to move
    hits = runs.join(keys, "s").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "term", "s"))).alias("hits"))
    state = f"struct<at:int,end:int,kept:array<struct<term:{key},matched:string>>>"
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("end"), F.array().cast(f"array<struct<term:{key},matched:string>>").alias("kept")).cast(state)

    def add(a: Column, x: Column) -> Column:
        end, first = x["at"] - x["less"], x["at"] != a["at"]
        kept = F.when(first & (a["end"] < end), F.concat(a["kept"], F.array(F.struct(x["term"].alias("term"), x["s"].alias("matched"))))).otherwise(a["kept"])
        return F.struct(x["at"].alias("at"), F.when(first, F.greatest(a["end"], end)).otherwise(a["end"]).alias("end"), kept.alias("kept")).cast(state)

    kept = hits.select("qid", F.array_sort(F.aggregate("hits", start, add, lambda a: a["kept"])).alias("kept"))
    return kept.select("qid", F.filter("kept", lambda x, i: (i == 0) | ~F.get("kept", i - 1)["term"].eqNullSafe(x["term"])).alias("terms"))


def named_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, term, matched) of terms named by abbreviation or by full name; of names that overlap at a place the longest counts.

    Questions give their runs of one to eight words, which meet abbreviations and names by equality.
    """
    return _named(questions, terms).select("qid", F.inline("terms"))


def term_index(records: DataFrame) -> DataFrame:
    """One record (seq, term, full_name, source_specs) an abbreviation in capitals: that with the most source specifications, then the first; records without one are left out."""
    rows = records.withColumn("term", F.upper(F.trim("term"))).where("term <> ''")
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce(F.size("source_specs"), F.lit(0)).desc(), "seq"))
    return rows.withColumn("_k", best).where("_k = 1").drop("_k")


def resolved_terms(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, term, place, is_primary): the terms that a question resolves to, names before abbreviations.

    Full names that the question says come first; only a question that says none is asked for its words
    in capitals. The primary term is the first name, else the longest abbreviation, ties by place.
    """
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9]+", " "), F.lit(" "))
    names = index.select("term", F.lower("full_name").alias("s")).where(F.coalesce("s", F.lit("")) != "").groupBy("s").agg(F.min("term").alias("term"))
    said = _named(questions, names.select("term", F.col("s").alias("full_name")))
    said = said.select("qid", F.filter("terms", lambda t: t["matched"] != F.lower(t["term"])).alias("terms"))
    told = questions.select("qid", "question").join(said, "qid", "left")
    words = told.where(F.coalesce(F.size("terms"), F.lit(0)) <= 0).select("qid", F.posexplode(F.regexp_extract_all("question", F.lit(r"\b([A-Z][A-Z0-9\-]+)\b"), 1)).alias("place", "term"))
    short = words.join(index.select("term").distinct(), "term", "left_semi").select("qid", "term", "place", (-F.length("term")).alias("turn"))
    named = told.where(F.size("terms") > 0).withColumn("low", plain(F.lower("question"))).select("qid", "low", F.inline("terms"))
    named = named.select("qid", "term", F.instr(F.col("low"), plain(F.col("matched"))).alias("place"), F.lit(0).alias("turn"))
    rows = named.unionByName(short).groupBy("qid").agg(F.collect_list(F.struct("turn", "place", "term")).alias("rows"))
    # A word that comes again counts once, where it comes first.
    first = F.filter(F.array_sort("rows"), lambda x: ~F.exists("rows", lambda y: (y["term"] == x["term"]) & (y["place"] < x["place"])))
    return rows.select("qid", F.posexplode(F.array_distinct(first)).alias("at", "r")).select("qid", "r.term", "r.place", (F.col("at") == 0).alias("is_primary"))


def specs_named(question: Column) -> Column:
    """ts_23_501 and the like for every specification that the question names, once each."""
    numbers = F.regexp_extract_all(question, F.lit(r"(?i)\b(?:TS|TR)\s*(\d{2}\.\d{3}(?:-\d+)?)"), 1)
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("ts_"), F.translate(n, ".", "_"))))


def expanded(question: Column, abbreviation: Column, full_name: Column) -> Column:
    """The question with the name of an abbreviation that it says, or the abbreviation of a name, added if missing."""
    low = F.lower(question)
    says_short, says_long = low.contains(F.lower(abbreviation)), low.contains(F.lower(full_name))
    return F.when(says_short & ~says_long, F.concat_ws(" ", question, full_name)).when(says_long & ~says_short, F.concat_ws(" ", question, abbreviation)).otherwise(question)


def is_report(spec_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(spec_id, r"^ts_\d{2}_(\d{3})", 1).try_cast("int") >= 700, F.lit(False))


def bias(question: Column, title: Column, spec_id: Column, chunk_type: Column, step_all: Column, step_hits: Column, op_prefix: Column, anchor: Column, chain: Column) -> Column:
    """The sum of what speaks for and against a clause, within -1 and 1."""
    q, t = F.lower(question), F.lower(F.coalesce(title, F.lit("")))
    on = lambda c: F.coalesce(c, F.lit(False))
    asked = F.filter(F.array(*[F.when(q.contains(p), F.lit(p)) for p in PROCEDURES]), lambda p: p.isNotNull())
    others = F.filter(F.array(*[F.when(~q.contains(p), F.lit(p)) for p in PROCEDURES]), lambda p: p.isNotNull())
    names_asked, names_other = F.exists(asked, lambda p: F.contains(t, p)), F.exists(others, lambda p: F.contains(t, p))
    weigh = lambda c, w: F.when(c, F.lit(BIAS[w])).otherwise(F.lit(0.0))
    more = F.least(F.lit(BIAS["step_cap"]), F.greatest(F.lit(0), F.coalesce(step_hits, F.lit(1)) - 1) * BIAS["step_more"])
    total = weigh(is_report(spec_id) & ~_any(q, STUDY_WORDS), "report") + weigh(t.rlike(r"impacts?\s+on\s+(services|existing|entities|the)"), "impacts")
    total = total + F.when(on(step_all), F.lit(BIAS["step_all"]) + more).otherwise(F.lit(0.0)) + weigh(on(op_prefix), "op_prefix") + weigh(on(anchor), "anchor") + weigh(on(chain), "chain")
    total = total + F.when(names_asked, F.lit(BIAS["on_topic"])).when((F.size(asked) > 0) & names_other & ~on(chain), F.lit(BIAS["off_topic"])).otherwise(F.lit(0.0))
    generic = ~on(step_all) & ~on(op_prefix) & ((F.lower(chunk_type) == "definition") | t.isin(*GENERAL_TITLES)) & ~names_asked
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total + weigh(on(generic), "generic")))


def study_and_function(score: Column, spec_id: Column, title: Column, functional: Column) -> Column:
    """Scores of reports times 0.7; of functional titles, where asked for, times 1.15."""
    return score * F.when(is_report(spec_id), 0.7).otherwise(1.0) * F.when(functional & F.lower(title).rlike(r"function"), 1.15).otherwise(1.0)


# Words of titles that narrow a procedure to a case, and the factors for general and for narrowed ones.
VARIANT_WORDS = (" with ", "re-allocation", "non-3gpp", "untrusted", "roaming", "disaster", "onboarding", "emergency", "interworking", " via ")
GENERAL_FACTOR, VARIANT_FACTOR = 1.12, 0.88


def generality(score: Column, title: Column) -> Column:
    """Scores of clauses titled as general raised, those of a procedure's special cases lowered."""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    return score * F.when(t.startswith("general"), GENERAL_FACTOR).when(_any(t, VARIANT_WORDS), VARIANT_FACTOR).otherwise(1.0)


def abstains(n_sources: Column, answer: Column) -> Column:
    """No sources, or an uncited answer that the context does not cover the question."""
    return (n_sources == 0) | (F.lower(answer).contains("context does not cover") & ~answer.rlike(r"\[\d+\]"))


# Topics outside the texts, and the forms of names that a question may claim to exist.
OUT_OF_SCOPE = ("6g", "5g loyalty", "subscription price", "monthly price", "wi-fi 7", "wifi 7", "release 20", "rel-20", "ai-native air interface", "concrete mix", "tower foundation", "quantum key")
ASKED_OPERATION = r"\bN[a-z0-9]{2,6}_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*\b"
ASKED_POINT = r"(?i)['\"]?\b(N\d{1,3})\b['\"]?\s+reference[ -]?point"
ASKED_SHORT = r"\(([A-Z]{2,6})\)"


def unknown(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Asked names (qid, name, pos, ..) that are no name of known (name)."""
    return asked.join(known.select("name").distinct(), "name", "left_anti")


def scope_warnings(questions: DataFrame, terms: DataFrame, operations: DataFrame, titles: DataFrame | None = None, resolved: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(qid, warning, rank): what a question (qid, question) names and the graph has not; at most four a question.

    In this order, each in the order of the text: topics out of scope; operations (op) that do not exist;
    reference points that no title (title) names as a word, in any case; abbreviations in brackets that are
    no term (term) and that the question has not been resolved to (qid, term). Without titles, points are not
    judged. A null question names nothing. Names meet by equality: titles are cut into the points they name.
    """
    text = F.coalesce("question", F.lit(""))
    named = lambda pattern, group: questions.select("qid", F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group))).alias("pos", "name"))
    topics = questions.select("qid", F.posexplode(F.filter(F.array(*[F.lit(t) for t in OUT_OF_SCOPE]), lambda t: F.contains(F.lower(text), t))).alias("pos", "name"))
    parts = [(topics, "out of scope: "), (unknown(named(ASKED_OPERATION, 0), operations.select(F.col("op").cast("string").alias("name"))), "unknown operation ")]
    if titles is not None:
        points = titles.select(F.explode(F.regexp_extract_all(F.upper(F.coalesce("title", F.lit(""))), F.lit(r"\bN\d{1,3}\b"), 0)).alias("name"))
        asked = named(ASKED_POINT, 1).select("qid", "pos", F.upper("name").alias("name"), F.col("name").alias("as_asked"))
        parts.append((unknown(asked, points).select("qid", "pos", F.col("as_asked").alias("name")), "unknown reference point "))
    short = unknown(named(ASKED_SHORT, 1), terms.select(F.col("term").cast("string").alias("name")))
    if resolved is not None:
        short = short.join(resolved.select("qid", F.col("term").cast("string").alias("name")), ["qid", "name"], "left_anti")
    parts.append((short, "unknown abbreviation "))
    rows = None
    for k, (df, says) in enumerate(parts):
        one = df.select("qid", F.lit(k).alias("kind"), "pos", F.concat(F.lit(says), "name").alias("warning"))
        rows = one if rows is None else rows.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("kind", "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("qid", "warning", "rank")


def content_words(c: Column) -> Column:
    """The words of a text in order, stemmed and without stop words.

    A word in capitals counts even where it spells a stop word, the plural of one is the one, and "to"
    and "from" stay, so that their order can be told.
    """
    raw = F.filter(F.split(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9']+"), lambda w: w != "")
    plural = lambda w: (F.length(w) >= 3) & w.rlike(r"^[A-Z0-9]*[A-Z][A-Z0-9]*s$")
    low = lambda w: F.when(plural(w), F.lower(F.regexp_replace(w, "s$", ""))).otherwise(F.lower(w))
    capital = lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & w.rlike("[A-Z]")
    never = lambda w: F.lower(w).isin(*T.TITLE_JOINTS)
    kept = F.filter(raw, lambda w: ~never(w) & (capital(w) | low(w).isin("to", "from") | ~low(w).isin(*T.MATCH_STOP)))
    return F.transform(kept, lambda w: T.stem(low(w)))


def _in_order(title: Column, question: Column) -> Column:
    """Whether the title's words stand in the question in their order, each after the one before."""
    step = lambda at, w: F.when(at < 0, at).otherwise(F.when(F.array_position(F.slice(question, at + 1, F.greatest(F.size(question) - at, F.lit(0))), w) > 0, at + F.array_position(F.slice(question, at + 1, F.greatest(F.size(question) - at, F.lit(0))), w).cast("int")).otherwise(-1))
    return F.aggregate(title, F.lit(0), step) >= 0


def root_headings(questions: DataFrame, headings: DataFrame, least: float = 0.75, before: int = 12) -> DataFrame:
    """(qid, chunk_id, coverage): for each question the heading (chunk_id, spec_id, title, size) that names its procedure.

    Only headings of the first specification that the question cites are asked. The last `before` words
    in front of that citation come first; only where they name no heading, the whole question does. A
    heading qualifies if three quarters of its words stand there, and in its order where it has "to" or
    "from"; one of a single word only against few words. Then near complete coverage (0.9) counts, then
    two words or more, then the larger subtree, then the id. A question that cites none has no root.
    """
    cited = r"(?s)^(.*?)\bT[SR]\s*(\d{2})\.(\d{3}(?:-\d+)?)"
    q = questions.where(F.col("question").rlike(cited)).select("qid", F.concat_ws("_", F.lit("ts"), F.regexp_extract("question", cited, 2), F.regexp_extract("question", cited, 3)).alias("spec_id"), content_words(F.regexp_extract("question", cited, 1)).alias("front"), content_words(F.col("question")).alias("all"))
    front = F.slice("front", F.greatest(F.size("front") - before + 1, F.lit(1)), before)
    asked = q.select("qid", "spec_id", F.explode(F.array(F.struct(F.lit(1).alias("pass"), front.alias("qw")), F.struct(F.lit(2).alias("pass"), F.col("all").alias("qw")))).alias("p")).select("qid", "spec_id", "p.pass", "p.qw")
    h = headings.select("chunk_id", F.col("spec_id").cast("string").alias("spec_id"), F.col("size").alias("subtree"), content_words(F.col("title")).alias("tw"))
    met = asked.join(h, "spec_id").withColumn("own", F.array_distinct("tw")).withColumn("hit", F.size(F.array_intersect("own", "qw")))
    short = (F.size("own") >= 2) | ((F.size("tw") == 1) & (F.size("qw") <= before))
    directed = F.arrays_overlap("tw", F.array(F.lit("to"), F.lit("from")))
    fits = met.where((F.col("hit") > 0) & short).withColumn("coverage", F.round(F.col("hit") / F.size("own"), 6)).where((F.col("coverage") >= least) & (~directed | _in_order(F.col("tw"), F.col("qw"))))
    best = Window.partitionBy("qid").orderBy("pass", (F.col("coverage") >= 0.9).desc(), (F.col("hit") >= 2).desc(), F.desc("subtree"), "chunk_id")
    return fits.withColumn("k", F.row_number().over(best)).where("k = 1").select("qid", "chunk_id", "coverage")


#: Ids of headings of one title that a row holds, and keys that a title's runs are spread over.
BLOCK_HEADINGS, SPREAD = 4096, 8
#: Most bytes of headings' ids that are broadcast to texts, and of one of them with its share of a block.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 16
# Headings that name nothing, and nouns of entities, which no flow is named after.
GENERIC_TITLES = ("general", "description", "overview", "introduction", "procedures", "procedure", "requirements", "test requirements", "initial conditions", "test procedure", "test purpose", "definitions", "abbreviations", "scope", "references", "void")


def plain_words(c: Column) -> Column:
    """Lower-case words with single spaces between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9']+", " ")), F.lit(" "))


def names_in_text(flows: DataFrame, headings: DataFrame, least_words: int = 3) -> DataFrame:
    """(flow, chunk_id): headings (chunk_id, title) of three words or more that stand literally in a flow's text (flow, text).

    A text's runs of words, as long as the titles there are, meet the distinct titles by equality, and the runs that
    are titles then meet the headings of that title, in blocks of BLOCK_HEADINGS ids. Headings may share a title, so the
    pairs can be as many as flows times headings: none of them is moved, but for headings of several titles. Blocks go
    to the runs if the headings are counted few (BROADCAST_BYTES of ids), else both move, blocks SPREAD times.
    """
    few = headings.count() * ID_BYTES <= BROADCAST_BYTES
    titles = headings.select("chunk_id", F.trim(plain_words(F.col("title"))).alias("s")).where(~F.col("s").isin(*GENERIC_TITLES)).withColumn("n", F.size(F.split("s", " "))).where(F.col("n") >= least_words).distinct()
    lengths = titles.select("n").distinct()
    words = flows.select("flow", F.split(F.trim(plain_words(F.col("text"))), " ").alias("w"))
    runs = words.crossJoin(F.broadcast(lengths)).where(F.size("w") >= F.col("n"))  # one row a length of titles: a handful
    runs = runs.select("flow", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("s"))
    runs = runs.join(titles.select("s").distinct(), "s", "left_semi").distinct()
    several = titles.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("titles")).where("titles > 1").select("chunk_id")
    block = F.floor((F.row_number().over(Window.partitionBy("s", "bin").orderBy("chunk_id")) - 1) / BLOCK_HEADINGS)
    one = titles.join(several, "chunk_id", "left_anti").withColumn("bin", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)))
    blocks = one.withColumn("block", block).groupBy("s", "bin", "block").agg(F.collect_list("chunk_id").alias("ids"))
    # Each run of words meets all blocks of its title; where blocks move, a frequent title's runs are spread over SPREAD keys.
    spread = blocks.select("s", "ids", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    held = runs.join(F.broadcast(blocks.select("s", "ids")), "s") if few else runs.withColumn("part", F.pmod(F.xxhash64("flow"), F.lit(SPREAD)).cast("int")).join(spread, ["s", "part"])
    met = held.select("flow", F.explode("ids").alias("chunk_id"))
    return met.unionByName(runs.join(titles.join(several, "chunk_id", "left_semi"), "s").select("flow", "chunk_id").distinct())


def names_in_question(questions: DataFrame, headings: DataFrame, least: float = 0.75) -> DataFrame:
    """(qid, chunk_id): headings of which three quarters of the words, and two at least, stand in the question."""
    h = headings.select("chunk_id", F.array_distinct(content_words(F.col("title"))).alias("tw")).where(F.size("tw") >= 2)
    h = h.select("chunk_id", F.size("tw").alias("n"), F.explode("tw").alias("w"))
    q = questions.select("qid", F.explode(F.array_distinct(content_words(F.col("question")))).alias("w"))
    hits = q.join(h, "w").groupBy("qid", "chunk_id", "n").agg(F.count(F.lit(1)).alias("hit"))
    return hits.where((F.col("hit") >= 2) & (F.col("hit") >= least * F.col("n"))).select("qid", "chunk_id")


def closure(roots: DataFrame, chunks: DataFrame, refs: DataFrame, describes: DataFrame | None = None, most: int = 60, others: DataFrame | None = None, named: DataFrame | None = None, texts: bool = False, questions: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, role, score): what belongs to a procedure, by its clauses' texts and citations.

    The root and its subtree are main; then come chunks that define operations which the main or named ones
    describe (their titles have the name), the subtrees of the other procedures that the question names
    (named: qid, chunk_id), and what the main ones cite. With `texts`, headings of the root's or a cited
    specification whose titles the main clauses write out follow (named_in_text), and with the questions (qid, question)
    headings of the other cited specifications that they cover (cited_spec). others: (qid, chunk_id,
    role) of any other role. A chunk has the first of its roles in this order.
    """
    exploded = chunks.select("chunk_id", "spec_id", F.explode(T.prefixes(F.col("section_id"))).alias("section_id"))

    def subtree(heads: DataFrame) -> DataFrame:
        placed = heads.select("qid", "chunk_id").join(chunks.select("chunk_id", "spec_id", "section_id"), "chunk_id")
        below = placed.select("qid", "spec_id", "section_id").join(exploded, ["spec_id", "section_id"]).select("qid", "chunk_id")
        return placed.select("qid", "chunk_id").union(below).distinct()

    main = subtree(roots)
    cited = main.select("qid", F.col("chunk_id").alias("src")).join(refs.select("src", "dst"), "src").select("qid", F.col("dst").alias("chunk_id"))
    rows = main.withColumn("role", F.lit("main")).unionByName(cited.withColumn("role", F.lit("ref")))
    speaking = main
    if named is not None:
        speaking = main.union(subtree(named)).distinct()
        rows = rows.unionByName(subtree(named).withColumn("role", F.lit("named")))
    if describes is not None:
        ops = speaking.join(describes, "chunk_id").select("qid", "op").distinct()
        defining = describes.join(chunks.select("chunk_id", "title"), "chunk_id").where(F.col("title").contains(F.col("op")))
        rows = rows.unionByName(ops.join(defining, "op").select("qid", "chunk_id", F.lit("op_def").alias("role")))
    placed = chunks.select("chunk_id", "spec_id")
    own = main.join(placed, "chunk_id").select("qid", "spec_id").distinct()
    specs = own.unionByName(cited.join(placed, "chunk_id").select("qid", "spec_id")).distinct()
    if questions is not None:
        heads = chunks.select("chunk_id", "title").where(~F.trim(plain_words(F.col("title"))).isin(*GENERIC_TITLES))
        covered = names_in_question(questions, heads).join(placed, "chunk_id")
        covered = covered.join(specs, ["qid", "spec_id"], "left_semi").join(own, ["qid", "spec_id"], "left_anti")
        rows = rows.unionByName(covered.select("qid", "chunk_id", F.lit("cited_spec").alias("role")))
    if texts:
        flows = main.join(chunks.select("chunk_id", "content"), "chunk_id").select(F.struct("qid", "chunk_id").alias("flow"), F.col("content").alias("text"))
        said = names_in_text(flows, chunks.select("chunk_id", "title")).select("flow.qid", "chunk_id").distinct()
        said = said.join(placed, "chunk_id").join(specs, ["qid", "spec_id"], "left_semi")
        rows = rows.unionByName(said.select("qid", "chunk_id", F.lit("named_in_text").alias("role")))
    if others is not None:
        rows = rows.unionByName(others.select("qid", "chunk_id", "role"))
    order = (*TEXT_ROLES, *[r for r in ROLES if r not in TEXT_ROLES])
    return assemble(rows, chunks, order, most).drop("position")
