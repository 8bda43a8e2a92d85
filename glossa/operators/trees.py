"""Features of tokens in dependency trees, as joins and aggregates of the tokens table.

Children of a token are one aggregate over (key, head); every feature that asks about children reads a flag of
it. All functions take and return DataFrames with the key columns and i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of the child mask, licenses and closed classes.
MASK = (("dobj", 1), ("iobj", 2), ("prep", 4), ("advmod", 8), ("xcomp", 16))
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would", "do", "does", "did")
QUANTIFIERS = ("some", "any", "all", "many", "much", "few", "no")
REFLEXIVES = ("himself", "herself", "themselves", "itself", "myself", "yourself")
CLOSED = ("DET", "ADP", "PRON", "AUX", "PUNCT", "NUM")
PRONOUN_GENDER = {"he": "m", "him": "m", "his": "m", "himself": "m", "she": "f", "her": "f", "hers": "f", "herself": "f", "it": "n", "its": "n", "itself": "n"}
EVIDENCE_SINGULAR, EVIDENCE_PLURAL = ("a", "an", "this", "that", "un", "une", "le", "la", "el"), ("these", "those", "many", "few", "les", "des", "die")


#: Flags of the children of a token, by their relations.
FLAGS = (("obj", ("dobj",)), ("iobj", ("iobj",)), ("prep", ("prep",)), ("xcomp", ("xcomp",)), ("aux", ("aux",)), ("det", ("det", "nummod", "poss")), ("expl", ("expl",)), ("adv", ("advmod",)), ("passive", ("nsubjpass", "auxpass")))


def mask_bit(dep: Column) -> Column:
    mask = F.lit(0)
    for name, bit in MASK:
        mask = F.when(dep == name, bit).otherwise(mask)
    return mask


def children(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, flags) of what each governing token governs."""
    dep = F.col("dep")
    kids = tokens.filter(F.col("head") != F.col("i")).select(*key, F.col("head").alias("i"), "dep", "lemma", "pos", "tag", F.col("i").alias("child"))
    return kids.groupBy(*key, "i").agg(
        F.bit_or(mask_bit(dep)).alias("mask"),
        *(F.bool_or(dep.isin(*names)).alias(f"has_{flag}") for flag, names in FLAGS),
        F.array_sort(F.collect_set(F.when((dep == "prep") & (F.col("lemma") != "by"), F.col("lemma")))).alias("preps"),
        F.max(F.when(dep == "prep", F.struct("child", "lemma")))["lemma"].alias("last_prep"),
        F.min(F.when(dep.isin("nsubj", "expl"), F.struct("child", "lemma", "dep"))).alias("subject"),
        F.count(F.lit(1)).alias("n_children"),
    )


def with_children(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Tokens with the flags of their children, false or empty for leaves."""
    kids = children(tokens, key)
    out = tokens.join(kids, [*key, "i"], "left")
    flags = [c for c in kids.columns if c.startswith("has_")]
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"mask": F.coalesce("mask", F.lit(0)), "preps": F.coalesce("preps", F.array().cast("array<string>")), "n_children": F.coalesce("n_children", F.lit(0))})


def frame() -> Column:
    """The verb frame from the flags of its children."""
    return (
        F.when(F.col("has_passive"), "trans")
        .when(F.col("has_iobj") | (F.col("has_obj") & F.col("has_prep")), "ditrans")
        .when(F.col("has_obj"), "trans")
        .otherwise("intrans")
    )


def complement_kind() -> Column:
    """What a verb takes besides its subject."""
    return F.when(F.col("has_xcomp"), "CP_TO").when(F.col("has_obj") & F.col("has_iobj"), "DOUBLE_OBJ").when(F.col("has_obj"), "NP_OBJ").otherwise("NONE")


def verb_license() -> Column:
    """The license that a verb's to-infinitive asks of a replacement."""
    subject = F.col("subject.dep")
    return F.when(~F.col("has_xcomp"), F.lit(None).cast("string")).when(F.col("has_expl") & (F.col("subject.lemma") == "there"), "there").when(F.col("has_expl"), "ecm_it").when(F.col("has_obj"), "obj").when(F.col("has_passive"), "subjpass").when(subject.isNotNull(), "subj")


def bare_singular() -> Column:
    """A singular noun without determiner, possessor or number."""
    return (F.col("tag") == "NN") & ~F.col("has_det") & (F.col("dep") != "nmod")


def noun_tag(evidence: Column) -> Column:
    """NN or NNS as determiners say; conflicting or no evidence keeps the tag (I10, I12). evidence: array of lemmas."""
    one = F.exists(evidence, lambda w: w.isin(*EVIDENCE_SINGULAR))
    many = F.exists(evidence, lambda w: w.isin(*EVIDENCE_PLURAL))
    return F.when(one & ~many & (F.col("tag") == "NNS"), "NN").when(many & ~one & (F.col("tag") == "NN"), "NNS").otherwise(F.col("tag"))


def forced_number(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, tag, forced) of nouns, by the determiners they govern."""
    dets = tokens.filter(F.col("dep") == "det").groupBy(*key, F.col("head").alias("i")).agg(F.array_sort(F.collect_set("lemma")).alias("evidence"))
    nouns = tokens.filter(F.col("tag").isin("NN", "NNS")).join(dets, [*key, "i"], "left")
    return nouns.select(*key, "i", "tag", noun_tag(F.coalesce("evidence", F.array().cast("array<string>"))).alias("forced"))


def functionish() -> Column:
    """Tokens that a rewrite leaves alone: no letter, closed class, quantifier, modal, determiner-like."""
    return ~F.col("text").rlike(r"\p{L}") | F.col("pos").isin(*CLOSED) | F.col("dep").isin("det", "nummod", "predet") | F.col("lemma").isin(*QUANTIFIERS, *MODALS)


def pronoun_gender(form: Column) -> Column:
    """m, f or n of a pronoun."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in PRONOUN_GENDER.items() for x in kv)), F.lower(form))


def pronoun_class() -> Column:
    """SUBJ, OBJ, POSSDET or REFL."""
    return F.when(F.col("pos") != "PRON", None).when(F.col("lemma").isin(*REFLEXIVES), "REFL").when(F.col("dep") == "poss", "POSSDET").when(F.col("dep").isin("dobj", "iobj", "pobj"), "OBJ").otherwise("SUBJ")


def reflexive_subjects(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i of the reflexive, subject): the first subject of its head, else of the head's head (I16)."""
    heads = tokens.select(*key, F.col("i").alias("head"), F.col("head").alias("grand"))
    subjects = tokens.filter(F.col("dep").isin("nsubj", "nsubjpass")).groupBy(*key, F.col("head").alias("of")).agg(F.min("i").alias("subject"))
    refl = tokens.filter(F.col("lemma").isin(*REFLEXIVES)).select(*key, "i", "head").join(heads, [*key, "head"])
    near = refl.join(subjects.withColumnRenamed("of", "head").withColumnRenamed("subject", "s1"), [*key, "head"], "left")
    far = near.join(subjects.withColumnRenamed("of", "grand").withColumnRenamed("subject", "s2"), [*key, "grand"], "left")
    return far.select(*key, "i", F.coalesce("s1", "s2").alias("subject"))


def subject_verb(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, sent, subject, verb) for each subject of a verb."""
    verbs = tokens.filter(F.col("pos") == "VERB").select(*key, F.col("i").alias("verb"))
    return tokens.filter(F.col("dep").startswith("nsubj")).select(*key, "sent", F.col("i").alias("subject"), F.col("head").alias("verb")).join(verbs, [*key, "verb"])


def attractors(tokens: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Nouns strictly between a subject and its verb, counted."""
    nouns = tokens.filter(F.col("pos").isin("NOUN", "PROPN")).select(*key, "sent", "i")
    met = pairs.join(nouns, [*key, "sent"], "left")
    between = (F.col("i") > F.least("subject", "verb")) & (F.col("i") < F.greatest("subject", "verb"))
    return met.groupBy(*key, "sent", "subject", "verb").agg(F.count_if(between).alias("n_attractors"))


def context(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Tags beside each token and of its head, and its side of the head."""
    order = Window.partitionBy(*key, "sent").orderBy("i")
    heads = tokens.select(*key, F.col("i").alias("head"), F.col("tag").alias("head_tag"))
    rows = tokens.withColumn("prev_tag", F.coalesce(F.lag("tag").over(order), F.lit("START"))).withColumn("next_tag", F.coalesce(F.lead("tag").over(order), F.lit("END")))
    side = F.when(F.col("i") == F.col("head"), "ROOT").when(F.col("i") < F.col("head"), "LEFT").otherwise("RIGHT")
    return rows.withColumn("relpos", side).join(heads, [*key, "head"])


def placed_with_children(tokens: DataFrame, key: list[str]) -> DataFrame:
    """context() with the flags of with_children(), for keys that are neither null nor repeated: without a join.

    Every token stands once at its own place and once at its head's, where the two learn of each other. All windows are
    within a key: tokens that are dealt by it aren't moved again.
    """
    order, at, own = Window.partitionBy(*key, "sent").orderBy("i"), Window.partitionBy(*key, "_at"), F.col("_own")
    side = F.when(F.col("i") == F.col("head"), "ROOT").when(F.col("i") < F.col("head"), "LEFT").otherwise("RIGHT")
    rows = tokens.withColumn("prev_tag", F.coalesce(F.lag("tag").over(order), F.lit("START"))).withColumn("next_tag", F.coalesce(F.lead("tag").over(order), F.lit("END"))).withColumn("relpos", side)
    places = F.array(F.struct(F.col("i").alias("_at"), F.lit(True).alias("_own")), F.struct(F.col("head").alias("_at"), F.lit(False).alias("_own")))
    rows = rows.select("*", F.inline(places))
    child = ~own & (F.col("head") != F.col("i"))
    flags = {f"has_{flag}": F.coalesce(F.bool_or(F.when(child, F.col("dep").isin(*names))).over(at), F.lit(False)) for flag, names in FLAGS}
    mask = F.coalesce(F.bit_or(F.when(child, mask_bit(F.col("dep")))).over(at), F.lit(0))
    rows = rows.withColumns(flags | {"mask": mask, "_tag": F.max(F.when(own, F.col("tag"))).over(at)})
    told = F.max(F.when(~own, F.col("_tag"))).over(Window.partitionBy(*key, "i"))
    return rows.withColumn("head_tag", told).filter(own).drop("_at", "_own", "_tag")


def sentence_profiles(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Frames as a sorted multiset, expletives, to-infinitives after a copula: what a round trip must keep."""
    full = with_children(tokens, key)
    frames = full.filter(F.col("pos") == "VERB").select(*key, "sent", frame().alias("frame")).groupBy(*key, "sent").agg(F.array_join(F.array_sort(F.collect_list("frame")), " ").alias("frames"))
    rest = full.groupBy(*key, "sent").agg(
        F.count_if((F.col("dep") == "expl") & (F.col("lemma") == "there")).alias("there"),
        F.count_if((F.col("dep") == "expl") & (F.col("lemma") == "it")).alias("it"),
        F.count_if(F.col("has_aux") & F.col("has_xcomp") & F.col("has_obj")).alias("tough"),
        F.count_if(F.col("has_aux") & F.col("has_xcomp") & ~F.col("has_obj")).alias("raising"),
    )
    return rest.join(frames, [*key, "sent"], "left").withColumn("frames", F.coalesce("frames", F.lit("")))


def same_profile(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """(key, same): whether a rewritten sentence keeps the profile of its source."""
    parts = ["frames", "there", "it", "tough", "raising"]
    s, t = (p.select(*key, "sent", F.struct(*parts).alias(n)) for p, n in ((source, "s"), (target, "t")))
    return s.join(t, [*key, "sent"], "full_outer").groupBy(*key).agg(F.bool_and(F.col("s").eqNullSafe(F.col("t"))).alias("same"))


def subtree_spans(tokens: DataFrame, key: list[str], rounds: int = 4) -> DataFrame:
    """(key, i, first, last): the reach of each token's subtree up to `rounds` levels down."""
    reach = tokens.select(*key, "i", F.col("i").alias("first"), F.col("i").alias("last"))
    arcs = tokens.filter(F.col("head") != F.col("i")).select(*key, F.col("i").alias("child"), F.col("head").alias("i"))
    for _ in range(rounds):
        below = arcs.join(reach.withColumnRenamed("i", "child"), [*key, "child"]).select(*key, "i", "first", "last")
        reach = reach.unionByName(below).groupBy(*key, "i").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return reach


def phrase_matches(tokens: DataFrame, phrases: DataFrame, key: list[str], longest: int = 4) -> DataFrame:
    """(key, start, end, phrase) of multiword expressions, without case (I14, M24): an equi-join on joined words.

    phrases: phrase, words separated by one space, of at most `longest` words.
    """
    order = Window.partitionBy(*key, "sent").orderBy("i").rowsBetween(0, longest - 1)
    runs = tokens.withColumn("run", F.collect_list(F.lower("text")).over(order))
    grams = runs.select(*key, F.col("i").alias("start"), F.explode(F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("run", 1, n), " ").alias("phrase")))).alias("g"))
    found = grams.select(*key, "start", (F.col("start") + F.col("g.n")).alias("end"), F.col("g.phrase").alias("phrase"))
    return listed(found, phrases, key)


def phrases_of_words(texts: DataFrame, phrases: DataFrame, key: list[str], ends: tuple[str, ...], longest: int = 4) -> DataFrame:
    """phrase_matches() of texts that repeat no key and have their tokens in an array `words`: without a sort or window.

    ends: the tokens after which a sentence begins.
    """
    beside = F.arrays_zip(*(F.slice("words", n + 1, F.size("words")) for n in range(longest)))
    near = texts.select(*key, F.posexplode(beside).alias("start", "near"))
    words = [F.lower(F.col("near")[str(n)]) for n in range(longest)]
    runs, inside = [], F.lit(True)
    for n, word in enumerate(words):
        runs.append(F.when(inside & word.isNotNull(), F.concat_ws(" ", *words[: n + 1])))
        inside = inside & ~word.isin(*ends)
    grams = near.select(*key, "start", F.posexplode(F.array(*runs)).alias("more", "phrase"))
    return listed(grams.select(*key, "start", (F.col("start") + F.col("more") + 1).alias("end"), "phrase"), phrases, key)


def listed(grams: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """The grams that a list has: a semi join, which may broadcast the list but never the grams, however small their files."""
    return grams.join(phrases.select(F.lower("phrase").alias("phrase")), "phrase", "left_semi").select(*key, "start", "end", "phrase")


def licensed_sentences(tokens: DataFrame, key: list[str], items: list[str]) -> DataFrame:
    """Whether a sentence holds one of the listed items, by text or lemma."""
    hit = F.lower("text").isin(*items) | F.col("lemma").isin(*items)
    return tokens.groupBy(*key, "sent").agg(F.bool_or(hit).alias("licensed"))


def child_dep_counts(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, deps): sorted "dep:count" of each token's children."""
    counts = tokens.filter(F.col("head") != F.col("i")).groupBy(*key, F.col("head").alias("i"), "dep").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key, "i").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "dep", F.col("n").cast("string")))), " ").alias("deps"))


def fixed_expressions(tokens: DataFrame, key: list[str], relation: str = "fixed") -> DataFrame:
    """Heads with their children of one relation, in order, two words or more; distinct phrases."""
    kids = tokens.filter((F.col("dep") == relation) & (F.col("head") != F.col("i"))).select(*key, F.col("head").alias("top"), "i", F.lower("text").alias("w"))
    heads = tokens.select(*key, F.col("i").alias("top"), "i", F.lower("text").alias("w")).join(kids.select(*key, "top").distinct(), [*key, "top"], "left_semi")
    rows = kids.unionByName(heads).groupBy(*key, "top").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"))
    return rows.select(F.array_join(F.transform("ws", lambda s: s["w"]), " ").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def function_words(tokens: DataFrame) -> DataFrame:
    """Distinct lower-case words of closed classes."""
    return tokens.filter(F.col("pos").isin("DET", "ADP", "PRON", "AUX") & F.col("text").rlike(r"^\p{L}+$")).select(F.lower("text").alias("word")).distinct()


def particle_verbs(tokens: DataFrame, key: list[str], relation: str = "prep") -> DataFrame:
    """Distinct verb and particle pairs."""
    parts = tokens.filter(F.col("dep") == relation).select(*key, F.col("head").alias("i"), F.col("lemma").alias("particle"))
    verbs = tokens.filter(F.col("pos") == "VERB").select(*key, "i", F.col("lemma").alias("verb"))
    return verbs.join(parts, [*key, "i"]).select("verb", "particle").distinct()


def heavy_auxiliaries(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Verbs with a perfect or passive periphrasis: two auxiliaries, or one that isn't a modal beside a participle (M8)."""
    aux = tokens.filter(F.col("dep").isin("aux", "auxpass")).groupBy(*key, F.col("head").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("lemma").isin(*MODALS)).alias("full"))
    verbs = tokens.filter(F.col("pos") == "VERB").join(aux, [*key, "i"], "left")
    heavy = (F.col("n") > 1) | (F.col("full") & F.col("tag").isin("VBN", "VBD"))
    return verbs.select(*key, "i", F.coalesce(heavy, F.lit(False)).alias("heavy"))


def slot_kind() -> Column:
    """What a rewrite does with a token, the first rule that holds: frozen, pron, propn, verb, noun, adj, adv or pass."""
    kind = F.when(F.col("pos") == "PRON", "pron").when(functionish(), "frozen")
    for pos, name in (("PROPN", "propn"), ("VERB", "verb"), ("NOUN", "noun"), ("ADJ", "adj"), ("ADV", "adv")):
        kind = kind.when(F.col("pos") == pos, name)
    return kind.otherwise("pass")


#: Tags and words of questions.
WH_TAGS, WH_WORDS = ("WP", "WDT", "WRB", "WP$"), ("what", "which", "who", "whom", "whose")


def interrogative(kinds: Column, asks: Column) -> Column:
    """Whether a wh token asks: by its pronoun types (an array, null or empty if unknown), else in a text that ends with ?."""
    known = F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0
    return F.coalesce(F.col("tag").isin(*WH_TAGS), F.lit(False)) & F.when(known, F.array_contains(kinds, "Int")).otherwise(asks)


def morph_signature(morph: Column) -> Column:
    """A map of morphological features as sorted entries."""
    return F.array_sort(F.map_entries(morph))


def governed_prepositions(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i): prepositions that a verb governs, as its child or as the case of its oblique."""
    up = tokens.select(*key, F.col("i").alias("head"), F.col("pos").alias("h_pos"), F.col("dep").alias("h_dep"), F.col("head").alias("grand"))
    over = tokens.select(*key, F.col("i").alias("grand"), F.col("pos").alias("g_pos"))
    rows = tokens.filter((F.col("pos") == "ADP") & (F.col("head") != F.col("i"))).join(up, [*key, "head"]).join(over, [*key, "grand"])
    verb = lambda c: F.col(c).isin("VERB", "AUX")
    direct = (F.col("dep") == "prep") & verb("h_pos") & ~((F.col("lemma") == "to") & (F.col("h_dep") == "xcomp"))
    oblique = (F.col("dep") == "case") & F.col("h_dep").startswith("obl") & verb("g_pos")
    return rows.filter(direct | oblique).select(*key, "i")


def verb_prepositions(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, preps): prepositions that pair with a verb: its own, those of its nominal dependents, and the next token."""
    adp = tokens.filter((F.col("pos") == "ADP") & F.col("dep").isin("prep", "case"))
    verbs = tokens.filter(F.col("pos") == "VERB").select(*key, "i")
    own = adp.select(*key, F.col("head").alias("i"), "lemma")
    nominal = tokens.filter(F.col("dep").isin("obl", "nmod", "obj", "dobj", "iobj", "pobj", "attr")).select(*key, F.col("i").alias("n"), F.col("head").alias("i"))
    below = adp.select(*key, F.col("head").alias("n"), "lemma").join(nominal, [*key, "n"]).select(*key, "i", "lemma")
    after = adp.select(*key, (F.col("i") - 1).alias("i"), "lemma")
    found = verbs.join(own.unionByName(below).unionByName(after), [*key, "i"], "left")
    return found.groupBy(*key, "i").agg(F.array_sort(F.collect_set("lemma")).alias("preps"))


def descendants(tokens: DataFrame, key: list[str], rounds: int = 4) -> DataFrame:
    """(key, top, i): each token and all below it, up to `rounds` levels."""
    arcs = tokens.filter(F.col("head") != F.col("i")).select(*key, F.col("head").alias("i"), F.col("i").alias("child"))
    out = level = tokens.select(*key, F.col("i").alias("top"), "i")
    for _ in range(rounds):
        level = level.join(arcs, [*key, "i"]).select(*key, "top", F.col("child").alias("i"))
        out = out.unionByName(level)
    return out.distinct()


def expletive_contexts(tokens: DataFrame, key: list[str], be: tuple[str, ...] = ("be",), to: tuple[str, ...] = ("to",)) -> DataFrame:
    """(key, i): verbs over a to-be clause with an expletive there below them or it as their object."""
    below = descendants(tokens, key).join(tokens.select(*key, "i", "lemma", "pos", "dep"), [*key, "i"])
    marks = below.groupBy(*key, "top").agg(
        F.bool_or(F.col("lemma").isin(*be) & F.col("pos").isin("AUX", "VERB")).alias("has_be"),
        F.bool_or(F.col("lemma").isin(*to)).alias("has_to"),
        F.bool_or((F.col("lemma") == "there") & F.col("dep").isin("expl", "nsubj")).alias("has_there"),
    )
    clauses = tokens.filter(F.col("dep") == "xcomp").select(*key, F.col("i").alias("top"), F.col("head").alias("of")).join(marks.filter("has_be and has_to"), [*key, "top"]).select(*key, "of")
    through = tokens.filter((F.col("pos") == "ADJ") & F.col("dep").isin("acomp", "attr")).select(*key, F.col("i").alias("of"), F.col("head").alias("i"))
    over = clauses.select(*key, F.col("of").alias("i")).unionByName(clauses.join(through, [*key, "of"]).select(*key, "i")).distinct()
    objects = tokens.filter(F.col("dep").isin("obj", "dobj") & (F.col("pos") == "PRON") & (F.col("lemma") == "it")).select(*key, F.col("head").alias("i"))
    said = marks.filter("has_there").select(*key, F.col("top").alias("i")).unionByName(objects).distinct()
    verbs = tokens.filter(F.col("pos").isin("VERB", "AUX")).select(*key, "i")
    return verbs.join(over, [*key, "i"], "left_semi").join(said, [*key, "i"], "left_semi")


def gap_frames(tokens: DataFrame, key: list[str], do: tuple[str, ...] = ("do",)) -> DataFrame:
    """(key, i, frame): frames of verbs, with the gap of a moved wh object counted as one.

    Only a verb without object, preposition or clause below it, with a subject that doesn't ask, in a sentence with a wh
    word and an auxiliary do.
    """
    wh = F.col("tag").startswith("W") | F.lower("text").isin(*WH_WORDS)
    full = with_children(tokens, key)
    sentences = tokens.groupBy(*key, "sent").agg(F.bool_or(wh).alias("has_wh"), F.bool_or((F.col("dep") == "aux") & F.col("lemma").isin(*do)).alias("has_do"))
    kids = tokens.filter(F.col("head") != F.col("i"))
    subjects = kids.filter(F.col("dep") == "nsubj").groupBy(*key, F.col("head").alias("i")).agg(F.min_by(~wh, "i").alias("plain_subject"))
    clauses = kids.filter(F.col("dep").isin("ccomp", "xcomp", "csubj")).select(*key, F.col("head").alias("i")).distinct().withColumn("has_clause", F.lit(True))
    rows = full.filter(F.col("pos") == "VERB").join(sentences, [*key, "sent"]).join(subjects, [*key, "i"], "left").join(clauses, [*key, "i"], "left")
    gap = (frame() == "intrans") & (F.size("preps") == 0) & F.col("has_clause").isNull() & ~F.col("has_obj") & F.coalesce("plain_subject", F.lit(False)) & F.col("has_wh") & F.col("has_do")
    return rows.select(*key, "i", F.when(gap, "trans").otherwise(frame()).alias("frame"))


def adjective_licenses(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, license): there, it or np of each adjective, by its host's expletive, then by its subject.

    The host of a predicate adjective is its head.
    """
    host = F.when(F.col("dep").isin("acomp", "attr"), F.col("head")).otherwise(F.col("i"))
    rows = tokens.filter(F.col("pos") == "ADJ").select(*key, "i", host.alias("host"))
    expletive = F.when((F.col("dep") == "expl") & F.col("lemma").isin("there", "it"), F.struct(F.lit(0).alias("r"), "i", F.col("lemma").alias("v")))
    subject = F.when(F.col("dep").isin("nsubj", "nsubjpass"), F.struct(F.lit(1).alias("r"), "i", F.when((F.col("pos") == "PRON") & (F.col("lemma") == "it"), "it").otherwise("np").alias("v")))
    kids = tokens.filter(F.col("head") != F.col("i")).select(*key, F.col("head").alias("host"), F.coalesce(expletive, subject).alias("e")).filter("e is not null")
    best = kids.groupBy(*key, "host").agg(F.min("e")["v"].alias("v"))
    return rows.join(best, [*key, "host"], "left").select(*key, "i", F.coalesce("v", F.lit("np")).alias("license"))
