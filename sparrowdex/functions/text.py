"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ﻿]"
#: The same in SQL's regular expressions.
SQL_SPACE = r"[\t\n\f\r ]"


def strip(c: Column, space: str) -> Column:
    return F.regexp_replace(c, rf"^{space}+|{space}+\z", "")  # $ would also match before U+0085, U+2028 or U+2029 at the end


def trim(c: Column) -> Column:
    """Strips all white space at both ends, not blanks only."""
    return strip(c, SPACE)


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def strip_html(c: Column) -> Column:
    """Text of a page: script and style bodies go, tags become blanks, white space collapses; entities stay as they are."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    return collapse(F.regexp_replace(bare, r"<[^>]+>", " "))


def strip_xml(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def normalise_markdown(c: Column) -> Column:
    """Lower case without markdown's signs, white space collapsed; for comparing snippets."""
    return collapse(F.regexp_replace(F.lower(c), r"[`*#>|_~\[\]()!\-]", " "))


def first_header(c: Column) -> Column:
    """Text of the first ATX heading, null without one."""
    found = F.regexp_extract(c, r"(?m)^#+\s+(.+)$", 1)
    return F.when(found != "", trim(found))


def entity_id(document_id: Column, name: Column) -> Column:
    return F.concat(document_id, F.lit("_"), F.regexp_replace(F.lower(name), r"[^a-z0-9]", "_"))


def relation_type(c: Column) -> Column:
    """An identifier in capitals; RELATED_TO if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", F.lit("RELATED_TO")).otherwise(F.coalesce(made, F.lit("RELATED_TO")))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_")


def blob_key(tenant: Column, document_id: Column, name: Column, asset: bool = False) -> Column:
    """Where a document's bytes (or an asset of it) are kept."""
    return F.concat_ws("/", F.lit("documents"), F.coalesce(tenant, F.lit("global")), document_id, *([F.lit("assets")] if asset else []), safe_name(name))


# -- captions --------------------------------------------------------------------------------------

#: Words that begin a meaningful caption, words that begin a printed one, and words that are no keywords of one.
KINDS = "gambar|tabel|grafik|diagram|foto|bagan|ilustrasi|peta"
CAPTION_STARTS = "gambar|figure|fig|tabel|table|chart|grafik|diagram"
CAPTION_STOPWORDS = "yang untuk pada dan dengan dari atau adalah dalam serta oleh hal ini itu para kepada gambar tabel raja dewa kitab hari suci".split()


def caption_meaningful(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rf"(?i)^\s*({KINDS})(?![A-Za-z0-9_])")


def caption_line(c: Column) -> Column:
    """Whether a printed line begins as a caption does."""
    return F.coalesce(trim(c), F.lit("")).rlike(rf"(?i)^({CAPTION_STARTS})(?![A-Za-z0-9_])")


def caption_keywords(c: Column) -> Column:
    body = F.regexp_replace(c, rf"(?i)^\s*({KINDS})\.?\s*[\d.]*", "")
    words = F.split(body, "[^A-Za-zÀ-ÿ]+")
    stop = F.array(*[F.lit(w) for w in CAPTION_STOPWORDS])
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, F.lower(w)))


def strip_bracket(c: Column) -> Column:
    return F.regexp_replace(c, r"^\[[^\]]*\]\s*", "")


def figure_kind(raw: Column) -> Column:
    return F.when(raw.isin("chart", "table"), raw).when(raw.isin("image", "image_block"), "image").otherwise("figure")


def label_of(context: Column, space: str = r"\s", ends: str = SPACE) -> Column:
    """The first fragment of 8 to 120 characters; else the first 100; null for none. space: what ends a sentence after its sign; ends: what goes at a fragment's ends."""
    parts = F.filter(F.transform(F.split(context, rf"\n|\.{space}|;{space}"), lambda s: strip(s, ends)), lambda s: F.length(s).between(8, 120))
    start = strip(F.substring(context, 1, 100), ends)
    return F.coalesce(F.get(parts, 0), F.when(start != "", start))


# -- router signals --------------------------------------------------------------------------------


def columnar_lines(text: Column) -> Column:
    """Lines with two wide gaps between visible text."""
    lines = F.transform(F.split(text, "\n"), trim)
    return F.size(F.filter(lines, lambda s: (F.length(s) >= 10) & (F.regexp_count(s, F.lit(r"\S\s{3,}\S")) >= 2)))


def currency_matches(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\$\s?[\d,]+(?:\.\d+)?"))


def text_layer_sufficient(text: Column, pages: Column, min_chars: int = 300, max_columnar: int = 5, max_currency: int = 10) -> Column:
    """Whether a text layer can stand for its document; cheap signals first."""
    return (
        F.when(text.isNull() | (text == "") | (F.length(text) < F.lit(min_chars) * pages), F.lit(False))
        .when(columnar_lines(text) > max_columnar, F.lit(False))
        .when(currency_matches(text) > max_currency, F.lit(False))
        .otherwise(F.lit(True))
    )


def pdf_scanned(text: Column, pages: Column) -> Column:
    """Fewer than 100 visible characters a page; an unreadable file counts as scanned."""
    visible = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.coalesce(visible / F.when(pages > 0, pages) < 100, F.lit(True))


# -- classification --------------------------------------------------------------------------------

#: Patterns of the intents, tried in this order.
INTENTS = {
    "enumerate": [
        r"\blist (semua|seluruh|all)\b",
        r"\bsebutkan (semua|seluruh)\b",
        r"\bshow (me )?(all|every)\b",
        r"\bwhat (documents|files) (do you|are)\b",
        r"\bapa saja (dokumen|file)",
        r"\bberapa (banyak|jumlah) (dokumen|file)",
        r"\bdaftar (semua|seluruh|lengkap)",
        r"\bdocuments? (do you have|are available)",
    ],
    "compare": [
        r"\bcompare\b",
        r"\bbandingkan\b",
        r"\bperbedaan(nya)? antara\b",
        r"\bdifference between\b",
        r"\b(A|X)\s+vs\.?\s+(B|Y)",
        r"\bversus\b",
        r"\bmana (yang )?(lebih|lebih baik)",
        r"\bwhich is (better|more)",
    ],
    "followup": [
        r"^(tell me more|more|continue|lanjut|lebih lanjut|terus|seterusnya)\b",
        r"^(lalu|kemudian|then|next|after that)\b",
        r"^(why|kenapa|mengapa)\??\s*$",
        r"\bitu\b",
        r"\bnya\b\s*$",
    ],
}


def intent(query: Column, prior_turns: Column | int = 0) -> tuple[Column, Column]:
    """(intent, reason) of a query; follow-ups need more than one earlier turn and a short query."""
    q = trim(F.coalesce(query, F.lit("")))
    turns = F.lit(prior_turns) if isinstance(prior_turns, int) else prior_turns
    name = F.when(q == "", "lookup")
    why = F.when(q == "", "empty-query")
    for kind, patterns in INTENTS.items():
        allowed = (turns > 1) & (F.length(q) < 80) if kind == "followup" else F.lit(True)
        for p in patterns:
            hit = allowed & q.rlike("(?i)" + p)
            name, why = name.when(hit, kind), why.when(hit, "pattern:" + p)
    return name.otherwise("lookup"), why.otherwise("default")


TABULAR = [".xlsx", ".xls", ".ods", ".csv", ".tsv", ".json", ".jsonl"]
CODE = [".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".rb", ".php", ".sh", ".sql", ".r", ".swift", ".kt", ".yaml", ".yml", ".toml", ".ini", ".env", ".log"]
IMAGES = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic"]
MODELS_3D = [".gltf", ".glb"]


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]*)$", 1))


def ingest_policy(name: Column, figure_mode: Column) -> Column:
    """struct(entities, figures, force_layout) of a file."""
    ext = extension(name)
    pdf = ext == ".pdf"
    plain = ~ext.isin(TABULAR + CODE + IMAGES + MODELS_3D)
    return F.struct(
        (pdf | plain).alias("entities"), (pdf & (figure_mode != "skip")).alias("figures"), (pdf & (figure_mode == "force")).alias("force_layout")
    )


def figure_mode(value: Column, legacy_force: Column | None = None) -> Column:
    chain = F.when(value.isin("force", "skip", "auto"), value)
    if legacy_force is not None:
        chain = chain.when(F.lower(legacy_force.cast("string")) == "true", "force")
    return chain.otherwise("auto")


def verdict(reply: Column) -> Column:
    """A gate's answer: YA as a word and no TIDAK; anything else is no."""
    word = lambda w: rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"
    return F.coalesce(reply.rlike(word("YA")) & ~reply.rlike(word("TIDAK")), F.lit(False))


# -- progress --------------------------------------------------------------------------------------

#: Cost of each step of an ingest job.
STEPS = {"queued": 0, "extracting": 45, "chunking": 4, "extracting_entities": 22, "processing_figures": 10, "embedding": 12, "storing": 7, "done": 0}

#: What each step is called.
STEP_NAMES = {
    "queued": "Queued",
    "extracting": "Extracting text",
    "chunking": "Chunking",
    "extracting_entities": "Analyzing entities",
    "processing_figures": "Processing figures",
    "embedding": "Embedding",
    "storing": "Storing",
    "done": "Done",
}


def step_name(step: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STEP_NAMES.items() for x in kv]), step), step)


def progress(step: Column, current: Column, total: Column, entities: Column, figures: Column) -> Column:
    """Percent of an ingest job: finished steps and the share of the current one, by cost; 100 only when done. Older rows' names of two steps count as well."""
    step = F.when(step == "entities", "extracting_entities").when(step == "figures", "processing_figures").otherwise(step)
    cost = {s: F.when(entities if s == "extracting_entities" else figures, F.lit(float(c))).otherwise(0.0) if s in ("extracting_entities", "processing_figures") else F.lit(float(c)) for s, c in STEPS.items()}
    whole = sum(cost.values(), F.lit(0.0))
    run, chain_before, chain_own = F.lit(0.0), None, None
    for s in STEPS:
        chain_before = F.when(step == s, run) if chain_before is None else chain_before.when(step == s, run)
        chain_own = F.when(step == s, cost[s]) if chain_own is None else chain_own.when(step == s, cost[s])
        run = run + cost[s]
    share = F.when((total > 0) & current.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), current / total))).otherwise(0.0)
    before, own = F.coalesce(chain_before, F.lit(0.0)), F.coalesce(chain_own, F.lit(0.0))
    percent = F.floor((before + own * share) * 100 / whole + 0.5).cast("int")
    return F.when(step == "done", 100).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), percent)))


def eta_seconds(percent: Column, started: Column, now: Column) -> Column:
    spent = F.unix_millis(now) - F.unix_millis(started)
    value = F.floor(spent * (100 - percent) / percent / 1000 + 0.5)
    return F.when((percent > 5) & (percent < 100) & started.isNotNull(), F.greatest(F.lit(1), value).cast("long"))


def progress_label(name: Column, current: Column, total: Column, eta: Column) -> Column:
    part = F.when((total > 0) & current.isNotNull(), F.concat(current.cast("string"), F.lit("/"), total.cast("string")))
    left = F.when(eta >= 60, F.concat(F.lit("~"), F.floor(eta / 60 + 0.5).cast("string"), F.lit(" min left"))).when(eta.isNotNull(), F.concat(F.lit("~"), eta.cast("string"), F.lit(" s left")))
    return F.concat_ws(" · ", name, part, left)


# -- small parsers ---------------------------------------------------------------------------------


def list_param(value: Column) -> Column:
    """A JSON array of strings, or else comma-separated values; blanks go."""
    made = F.when(trim(value).startswith("["), F.from_json(value, "array<string>"))
    parts = F.transform(F.coalesce(made, F.split(value, ",")), trim)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def salvage_array(reply: Column) -> Column:
    """The JSON array within a model's reply, null without one."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")


def distinct_queries(first: Column, more: Column) -> Column:
    """The query and its paraphrases, one of each up to case and white space, in order."""
    every = F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>")))
    tagged = F.transform(every, lambda q, i: F.struct(collapse(F.lower(q)).alias("k"), i.alias("i"), q.alias("q")))
    keep = F.filter(tagged, lambda x: ~F.exists(tagged, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"])) & (x["k"] != ""))
    return F.transform(keep, lambda x: x["q"])


def message_text(parts: Column) -> Column:
    """Text of a message's parts (struct type, text)."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), " ")


def citations(text: Column) -> Column:
    """Distinct citations in a text: array of struct(raw, title, section).

    Bracketed texts come first, then bold runs; plain numbers, notes and placeholders are none, and a bold run needs a digit, or a capital and six characters.
    """
    bracket = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]\n]{2,200})\]"), F.lit(0)), lambda r: F.struct(r.alias("raw"), trim(F.substring(r, 2, F.length(r) - 2)).alias("inner"), F.lit(False).alias("bold")))
    bold = F.transform(F.regexp_extract_all(text, F.lit(r"\*\*([^*\n]{2,200})\*\*"), F.lit(0)), lambda r: F.struct(r.alias("raw"), trim(F.substring(r, 3, F.length(r) - 4)).alias("inner"), F.lit(True).alias("bold")))
    fair = lambda x: (
        ~x["inner"].rlike(r"^\d+$")
        & ~x["inner"].startswith("^")
        & ~x["inner"].rlike(r"(?i)^(image|figure|table|chart|note):")
        & (~x["bold"] | x["inner"].rlike(r"\d") | (x["inner"].rlike("[A-Z]") & (F.length(x["inner"]) >= 6)))
    )
    split = lambda x: F.struct(x["raw"].alias("raw"), F.split(x["inner"], r"\s+[—–-]\s+").alias("p"))
    made = F.transform(
        F.transform(F.filter(F.concat(bracket, bold), fair), split),
        lambda x: F.struct(x["raw"].alias("raw"), trim(x["p"][0]).alias("title"), F.when(F.size(x["p"]) > 1, F.array_join(F.slice(x["p"], 2, F.greatest(F.size(x["p"]) - 1, F.lit(0))), " — ")).alias("section")),
    )
    ok = F.filter(made, lambda x: F.length(x["title"]) >= 2)
    # one pass: a citation is added unless its title and section are there, so the text isn't searched again for each pair
    same = lambda x, y: (y["title"] == x["title"]) & y["section"].eqNullSafe(x["section"])
    unique = lambda c: F.aggregate(c, F.slice(c, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return F.transform(F.array(ok), unique)[0]


def grounded(found: Column, titles: Column) -> Column:
    """Citations with supported set: the title holds, or is held by, a retrieved title."""
    held = lambda t: F.exists(titles, lambda n: F.contains(F.lower(n), F.lower(t)) | F.contains(F.lower(t), F.lower(n)))
    return F.transform(found, lambda c: F.struct(c["raw"].alias("raw"), c["title"].alias("title"), c["section"].alias("section"), held(c["title"]).alias("supported")))


def grounded_ratio(marked: Column) -> Column:
    n = F.size(marked)
    return F.when(n > 0, F.size(F.filter(marked, lambda c: c["supported"])) / n).otherwise(1.0)
