"""Categorization from precedents: by text, by vectors, and the re-scan after a correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import settings as s
from ledgerloom.functions.amounts import amounts_in_range, cents, cents_window
from ledgerloom.functions.decisions import decide_category
from ledgerloom.functions.text import normalize_noise, token_key
from ledgerloom.functions.vectors import boosted
from ledgerloom.operators.neighbours import distinct_vectors, nearest_neighbours, similar_vectors, vector_hash
from ledgerloom.operators.rangefirst import first_in_range
from ledgerloom.operators.textjoin import similar_texts
from ledgerloom.runtime import cut, unsent


def match_key(description: Column) -> Column:
    """What categorization compares: noise removed, words sorted, case kept."""
    return token_key(normalize_noise(description))


def _texts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("key")).distinct()


def _asked(rows: DataFrame) -> DataFrame:
    """Keys and amounts of the rows to match; read several times, so the texts are cleaned once."""
    return cut(
        rows.select(
            "transaction_id", match_key(F.col("description")).alias("q_key"), cents(F.col("amount")).alias("q_cents")
        )
    )


def _widest(cfg: s.Settings) -> Column:
    """Upper bound on the length of any amount interval that contains the item."""
    ratio, floor = int(cfg.amount_ratio) + 1, int(cfg.amount_floor * 100)
    return F.col("cents") * (ratio * ratio) + 4 * floor


def best_text_match(incoming: DataFrame, candidates: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Best precedent per incoming row: similar text, amount in range; a manual one beats all
    others, then the score, then the smaller id.

    Texts are compared once per distinct key; the best candidate is found per distinct
    (key, amount), so a description that fills a third of the ledger stays one key here.
    """
    asked = _asked(incoming)
    known = cut(
        candidates.select(
            F.col("transaction_id").alias("match_id"),
            match_key(F.col("description")).alias("c_key"),
            (F.col("category_source") == s.MANUAL).alias("manual"),
            cents(F.col("amount")).alias("cents"),
            "category_name",
            "category_source",
        )
    ).withColumn("reach", _widest(cfg))
    pairs = similar_texts(_texts(known, "c_key"), _texts(asked, "q_key"), cfg.text_threshold)
    pairs = cut(pairs.select(F.col("left_key").alias("c_key"), F.col("right_key").alias("q_key"), "score"))
    low, high = cents_window(F.col("q_cents"), cfg.amount_ratio, cfg.amount_floor)
    questions = (
        asked.select("q_key", "q_cents", low.alias("low"), high.alias("high"))
        .distinct()
        .join(pairs, "q_key")
        .withColumn("manual", F.explode(F.array(F.lit(True), F.lit(False))))
    )
    firsts = first_in_range(
        questions, known, ["c_key", "manual"], "match_id", ["category_name", "category_source"]
    )
    rank = F.struct(
        (~F.col("manual")).alias("not_manual"),
        (-F.col("score")).alias("minus_score"),
        F.col("item.order").alias("match_id"),
        F.col("item.category_name").alias("category_name"),
        F.col("item.category_source").alias("category_source"),
    )
    best = firsts.groupBy("q_key", "q_cents").agg(F.min(rank).alias("best"))
    return unsent(asked).join(best, ["q_key", "q_cents"]).select(
        "transaction_id",
        "best.match_id",
        F.col("best.category_name").alias("match_category"),
        F.col("best.category_source").alias("match_source"),
        (-F.col("best.minus_score")).alias("score"),
    )


def best_vector_match(
    incoming: DataFrame, index: DataFrame, candidates: DataFrame, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """Best precedent among the nearest vectors, the score raised when the model's label agrees.

    ``incoming``: transaction_id, amount, llm_category, vector. ``index``: id, vector. Ids of
    the index that are no candidates drop out after the nearest were chosen.
    """
    near = nearest_neighbours(
        incoming.select(F.col("transaction_id").alias("id"), "vector"),
        index,
        cfg.vector_top_k,
        cfg.vector_threshold - cfg.llm_boost,
    )
    known = candidates.select(
        F.col("transaction_id").alias("neighbour_id"),
        "category_name",
        "category_source",
        F.col("amount").alias("their_amount"),
    )
    score = boosted(F.col("score"), F.col("category_name"), F.col("llm_category"), cfg.llm_boost)
    eligible = (
        near.join(
            incoming.select(F.col("transaction_id").alias("query_id"), "amount", "llm_category"), "query_id"
        )
        .join(known, "neighbour_id")
        .withColumn("final", score)
        .where(F.col("final") >= cfg.vector_threshold)
        .where(amounts_in_range(F.col("amount"), F.col("their_amount"), cfg.amount_ratio, cfg.amount_floor))
    )
    rank = F.struct(
        (F.col("category_source") != s.MANUAL).alias("not_manual"),
        (-F.round(F.col("final") * 100, 2)).alias("minus_score"),
        "place",
        F.col("neighbour_id").alias("match_id"),
        "category_name",
        "category_source",
    )
    return eligible.groupBy(F.col("query_id").alias("transaction_id")).agg(F.min(rank).alias("best")).select(
        "transaction_id",
        "best.match_id",
        F.col("best.category_name").alias("match_category"),
        F.col("best.category_source").alias("match_source"),
        (-F.col("best.minus_score")).alias("score"),
    )


def with_decision(incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Similarity match and model label combined into category, source and disagreement."""
    return _decided(unsent(incoming).join(matches, "transaction_id", "left"))


def _decided(matched: DataFrame, *kept: str) -> DataFrame:
    """The decision for rows that stand next to their match, the columns ``kept`` before it."""
    decided = matched.withColumn("decision", decide_category(F.col("match_category"), F.col("llm_category")))
    return decided.select(
        *kept,
        "transaction_id",
        "decision.category",
        "decision.source",
        F.when(F.col("decision.source") == "similarity", F.col("match_id")).alias("precedent_id"),
        "decision.llm_suggested",
        "decision.disagrees",
        F.when(F.col("decision.disagrees"), F.col("match_category")).alias("similarity_category"),
        F.when(F.col("decision.disagrees"), F.round("score", 2)).alias("similarity_score"),
    )


def categorize(
    incoming: DataFrame, candidates: DataFrame, index: DataFrame | None = None, cfg: s.Settings = s.DEFAULTS
) -> DataFrame:
    """Vectors first, text for the rows they leave without a match, then the decision table.

    Candidates are the ledger as it stands before the batch. ``index`` is given when
    ``incoming`` carries a ``vector`` column.
    """
    if index is None:
        return with_decision(incoming, best_text_match(incoming, candidates, cfg))
    # read for the rows that it leaves and for the outcome: searched once
    by_vector = cut(best_vector_match(incoming, index, candidates, cfg))
    open_rows = incoming.join(by_vector.select("transaction_id"), "transaction_id", "left_anti")
    by_text = best_text_match(open_rows, candidates, cfg)
    return with_decision(incoming, by_vector.unionByName(by_text))


def categorize_run(incoming: DataFrame, candidates: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """``categorize`` by text for the rows of a run, each of which is a precedent for the rows after it.

    The order of ``transaction_id`` is the order of the run. A row that the run leaves undecided is no precedent, so
    which rows are depends on the decisions before them. All rows are decided at once, from the decisions of the round
    before, until none changes: a row is final once the rows before it that it could follow are, so the fixed
    point is the outcome of one row after the other. Rows of one text follow its first decided one, which
    settles in two rounds however many there are.
    """
    base = best_text_match(incoming, candidates, cfg).select(
        "transaction_id", F.col("match_id").cast("string").alias("match_id"), "match_category", "match_source", "score"
    )
    base = cut(base)
    rows = cut(
        incoming.select(
            "transaction_id", "llm_category", match_key(F.col("description")).alias("key"), cents(F.col("amount")).alias("cents")
        )
    )
    pairs = similar_texts(_texts(rows, "key"), _texts(rows, "key"), cfg.text_threshold)
    pairs = cut(pairs.select(F.col("left_key").alias("c_key"), F.col("right_key").alias("q_key"), "score"))
    low, high = cents_window(F.col("q_cents"), cfg.amount_ratio, cfg.amount_floor)
    asked = rows.select("transaction_id", F.col("key").alias("q_key"), F.col("cents").alias("q_cents"))
    questions = cut(asked.select("q_key", "q_cents", low.alias("low"), high.alias("high")).distinct().join(pairs, "q_key"))
    # all that a round asks of a row stands in one table: its text, amount, label and match in the ledger
    kept = ["llm_category", "key", "cents", *(f"base_{c}" for c in base.columns if c != "transaction_id")]
    facts = unsent(rows).join(base.toDF("transaction_id", *kept[3:]), "transaction_id", "left")
    facts = cut(facts.select("transaction_id", *kept))
    decided = cut(_decided(facts.withColumns({c.removeprefix("base_"): F.col(c) for c in kept[3:]}), *kept))
    while True:
        items = decided.where("source <> 'unsure'").select(
            F.col("transaction_id").alias("match_id"), F.col("key").alias("c_key"), "cents", "category", "source"
        )
        # the first row of a text in range is the best of it; it counts for the rows after it
        firsts = first_in_range(questions, items.withColumn("reach", _widest(cfg)), ["c_key"], "match_id", ["category", "source"])
        firsts = firsts.select("q_key", "q_cents", "score", "item.*")
        rank = F.struct((-F.col("score")).alias("minus"), F.col("order").cast("string").alias("match_id"), "category", "source")
        within = unsent(asked).join(firsts, ["q_key", "q_cents"]).where(F.col("order") < F.col("transaction_id"))
        within = within.groupBy("transaction_id").agg(F.min(rank).alias("own"))
        known = unsent(facts).join(within, "transaction_id", "left")
        # the ledger's rows come first among equals, and a manual one always
        stays = F.coalesce(
            (F.col("base_match_source") == s.MANUAL) | (F.col("base_score") >= -F.col("own.minus")), F.col("own").isNull()
        )
        matches = known.select(
            "transaction_id", *kept,
            F.when(stays, F.col("base_match_id")).otherwise(F.col("own.match_id")).alias("match_id"),
            F.when(stays, F.col("base_match_category")).otherwise(F.col("own.category")).alias("match_category"),
            F.when(stays, F.col("base_match_source")).otherwise(F.col("own.source")).alias("match_source"),
            F.when(stays, F.col("base_score")).otherwise(-F.col("own.minus")).alias("score"),
        )
        now = cut(_decided(matches, *kept))
        # all that the next round would take from this one
        told = ["transaction_id", "category", "source"]
        if now.select(*told).exceptAll(decided.select(*told)).isEmpty():
            return now.drop(*kept)
        decided = now


def _named_vectors(rows: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the name ``rep`` of their vector (-1 for none), and the distinct vectors."""
    if "vector" not in rows.columns:
        rows = rows.withColumn("vector", F.lit(None).cast("array<float>"))
    reps = cut(distinct_vectors(rows.where(F.col("vector").isNotNull()).select(F.col(id_column).alias("id"), "vector")))
    hashed = vector_hash(F.col("vector"))
    names = reps.select("vector", hashed.alias("hash"), "rep")
    named = unsent(rows.withColumn("hash", hashed)).join(names, ["hash", "vector"], "left").drop("hash", "vector")
    return named.withColumn("rep", F.coalesce("rep", F.lit(-1).cast("long"))), reps


def rescan(unsure: DataFrame, corrected: DataFrame, cfg: s.Settings = s.DEFAULTS) -> DataFrame:
    """Proposals of all open correction jobs for the undecided rows.

    ``unsure``: transaction_id, description, amount, and, if vectors are to be compared, llm_category and vector (null for
    none). ``corrected``: job_id, transaction_id, description, amount, category_name, category_source and vector; only manual
    rows are precedents. A job and a row are compared by their vectors, the score raised when the row's
    model label is the category that the job proposes; by their texts only where that comes to no match. Amounts must be in range for either.

    Jobs run in order of their id: the first one that reaches the auto-apply score, by whichever
    evidence, settles the row; later jobs do not see it, earlier weaker ones leave a pending proposal.

    A row's answer depends on its text, vector, model label and amount; rows that agree on them are one question. What
    vectors say about a pair is known per vector, label and category, so texts are never compared pair by pair with it: the
    first job by text is found per text, and only questions whose first job vectors have already judged look closer.
    """
    order = cfg.auto_apply_threshold
    if "llm_category" not in unsure.columns:
        unsure = unsure.withColumn("llm_category", F.lit(None).cast("string"))
    unsure, asked_vectors = _named_vectors(unsure, "transaction_id")
    manual, job_vectors = _named_vectors(corrected.where(F.col("category_source") == s.MANUAL), "job_id")
    asked = cut(
        unsure.select(
            "transaction_id", match_key(F.col("description")).alias("q_key"), cents(F.col("amount")).alias("q_cents"),
            F.col("rep").alias("q_rep"), F.coalesce("llm_category", F.lit(s.UNSURE)).alias("llm"),
        )
    )
    jobs = cut(
        manual.select(
            "job_id",
            match_key(F.col("description")).alias("c_key"),
            cents(F.col("amount")).alias("cents"),
            F.col("category_name").alias("proposed_category"),
            F.col("rep").alias("j_rep"),
        )
    ).withColumn("reach", _widest(cfg))
    question = ["q_key", "q_cents", "q_rep", "llm"]
    low, high = cents_window(F.col("q_cents"), cfg.amount_ratio, cfg.amount_floor)
    questions = cut(asked.select(*question, low.alias("low"), high.alias("high")).distinct())

    # what vectors say: (q_rep, llm, j_rep, proposed_category) with a score of at least the threshold
    near = similar_vectors(asked_vectors, job_vectors, cfg.vector_threshold - cfg.llm_boost)
    near = unsent(near.toDF("q_rep", "j_rep", "cosine")).join(questions.select("q_rep", "llm").distinct(), "q_rep")
    near = unsent(near).join(jobs.select("j_rep", "proposed_category").distinct(), "j_rep")
    raised = boosted(F.col("cosine"), F.col("proposed_category"), F.col("llm"), cfg.llm_boost)
    by_vector = ["q_rep", "llm", "j_rep", "proposed_category"]
    judged = cut(
        near.withColumn("raised", raised).where(F.col("raised") >= cfg.vector_threshold)
        .select(*by_vector, F.round(F.col("raised") * 100, 2).alias("score"))
    )
    texts = similar_texts(_texts(jobs, "c_key"), _texts(asked, "q_key"), cfg.text_threshold)
    texts = cut(texts.select(F.col("left_key").alias("c_key"), F.col("right_key").alias("q_key"), "score"))
    # all tables here grow with the ledger or with what it holds that is alike, and are small in files
    sides = unsent(questions)
    seen = judged.select(*by_vector)

    def firsts(found: DataFrame) -> DataFrame:
        return found.select(*question, "low", "high", F.col("item.order").alias("job_id"), "proposed_category", "score")

    strong_vectors = firsts(
        first_in_range(
            sides.join(judged.where(F.col("score") >= order), ["q_rep", "llm"]), jobs, ["j_rep", "proposed_category"], "job_id", []
        )
    )
    strong_texts = texts.where(F.col("score") >= order)
    tried = first_in_range(sides.join(strong_texts, "q_key"), jobs, ["c_key"], "job_id", ["proposed_category", "j_rep"])
    tried = cut(tried.withColumns({"j_rep": F.col("item.j_rep"), "proposed_category": F.col("item.proposed_category")}))
    taken = unsent(tried).join(seen, by_vector, "left_semi")
    # vectors have judged the first job by text: look among those of the text that they have not
    kinds = jobs.select("c_key", "j_rep", "proposed_category").distinct()
    closer = unsent(taken.select(*question, "low", "high", "c_key", "score")).join(kinds, "c_key")
    closer = unsent(closer).join(seen, by_vector, "left_anti")
    closer = first_in_range(closer, jobs, ["c_key", "j_rep", "proposed_category"], "job_id", [])
    strong = strong_vectors.unionByName(firsts(unsent(tried).join(seen, by_vector, "left_anti"))).unionByName(firsts(closer))
    first = F.min(F.struct("job_id", "proposed_category", "score")).alias("auto")
    settled = cut(strong.groupBy(*question).agg(first))

    # pairs below the auto-apply score, in range, of jobs that still see the row
    band = _band(cfg)
    open_questions = sides.join(settled.select(*question, F.col("auto.job_id").alias("settled_by")), question, "left")
    open_questions = cut(open_questions.withColumn("band", band("q_cents")))
    banded = jobs.withColumn("band", F.explode(F.sequence(band("cents") - 1, band("cents") + 1))).drop("reach")

    def weaker(evidence: DataFrame, on: list[str], of_job: list[str]) -> DataFrame:
        pairs = unsent(unsent(open_questions).join(evidence.where(F.col("score") < order), on)).join(banded, [*of_job, "band"])
        return pairs.where(F.col("cents").between(F.col("low"), F.col("high"))).where(
            F.col("settled_by").isNull() | (F.col("job_id") < F.col("settled_by"))
        )

    weak = weaker(judged, ["q_rep", "llm"], ["j_rep", "proposed_category"]).select(*question, "job_id", "proposed_category", "score")
    by_text = unsent(weaker(texts, ["q_key"], ["c_key"])).join(seen, by_vector, "left_anti")
    weak = weak.unionByName(by_text.select(weak.columns)).withColumn("status", F.lit("pending"))
    applied = settled.select(*question, "auto.*", F.lit("auto_applied").alias("status"))
    return unsent(asked).join(applied.unionByName(weak), question).select(
        "transaction_id", "job_id", "proposed_category", F.round("score", 2).alias("match_score"), "status"
    )


def _band(cfg: s.Settings):
    """Logarithmic amount band; amounts in range of each other lie at most one band apart."""
    ratio = float(cfg.amount_ratio)
    smallest = float(cfg.amount_floor) * 100 * ratio / (ratio - 1)

    def band(column: str) -> Column:
        size = F.greatest(F.col(column).cast("double"), F.lit(smallest))
        return F.floor(F.log(size) / F.log(F.lit(ratio * 1.000001))).cast("int")

    return band


def apply_rescan(ledger: DataFrame, proposals: DataFrame) -> DataFrame:
    """The ledger with auto-applied proposals written into it as similarity decisions."""
    applied = proposals.where(F.col("status") == "auto_applied").select("transaction_id", "proposed_category")
    joined = unsent(ledger).join(applied, "transaction_id", "left")
    hit = F.col("proposed_category").isNotNull()
    return joined.select(
        *[c for c in ledger.columns if c not in ("category", "category_source")],
        F.when(hit, F.col("proposed_category")).otherwise(F.col("category")).alias("category"),
        F.when(hit, F.lit("similarity")).otherwise(F.col("category_source")).alias("category_source"),
    )
