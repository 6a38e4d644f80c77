"""Rules over the catalog: batch selections, health, suggestions, registration, claims."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUNK_BYTES = 50 << 20
#: The base weight of each suggestion decides the order of the report.
WEIGHTS = {"register": 1_000_000, "kb": 900_000, "similar": 700_000, "junk": 600_000, "duplicates": 500_000, "cover": 300_000, "nonstandard": 200_000, "unclassified": 100_000}

#: Conditions of batch rules on a library's own row, by name; each takes the rule's value.
CONDITIONS = {
    "junk": lambda _: F.col("junk_bytes") > JUNK_BYTES,
    "no-cover": lambda _: F.col("has_nicnt") & (F.coalesce("cover_file", F.lit("")) == ""),
    "nonstandard": lambda _: ~F.col("has_nicnt"),
    "uncategorized": lambda _: F.trim(F.coalesce(F.col("category"), F.lit(""))) == "",
    "category=": lambda arg: F.lower("category") == arg.lower(),
    "name=": lambda arg: F.contains(F.lower("name"), F.lit(arg.lower())),
    "name~": lambda arg: F.contains(F.lower("name"), F.lit(arg.lower())),
    "min-size=": lambda arg: F.col("size_bytes") >= int(arg),
}
#: Conditions on other tables; ``related_ids`` gives the libraries that meet each.
RELATED = ("duplicate", "unregistered", "no-kb")
#: Overlap of two libraries' names from which on both count as duplicates.
DUPLICATE = 0.55


#: Rules of a collection reach the plan as literals; a table of more is an error, not cut.
MAX_RULES = 10_000


def rule_list(rules: DataFrame) -> list[tuple[str, list[str]]]:
    """Ordered rules (class, words) from a table (rank, class, word): classes by rank, then name."""
    rows = rules.select("rank", "class", "word").distinct().orderBy("rank", "class", "word").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found: dict[tuple, list[str]] = {}
    for rank, name, word in rows:
        if name is not None and word:
            found.setdefault((rank, name), []).append(word.lower())
    return [(name, words) for (_, name), words in found.items()]


# The actions and the phrases that may open a clause.
ACTIONS = ("list", "register", "build-kb", "rescan-manuals", "tag")
OPENINGS = ("foreach lib where ", "foreach library where ", "foreach lib ", "for lib where ")


def parse_batch(text: str) -> list[tuple[list[str], str, str]]:
    """Rules for ``batch_rules`` from their text form, one clause a line or up to a semicolon.

    A clause is ``[foreach lib where] condition [and condition ...] [: action[:argument]]``; a comma
    may stand for "and", a line that starts with # is left out, and without an action it lists. A
    clause without conditions or with an unknown action is an error.
    """
    rules = []
    for clause in map(str.strip, re.split(r"[\n;]", text.replace("\r", ""))):
        if not clause or clause.startswith("#"):
            continue
        opening = next((o for o in OPENINGS if clause.lower().startswith(o)), "")
        wanted, _, does = clause[len(opening) :].partition(":")
        action, _, arg = does.strip().partition(":")
        action = action.strip().lower() or "list"
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}; known are {', '.join(ACTIONS)}")
        conditions = list(filter(None, map(str.strip, re.split(r" and |,", wanted, flags=re.I))))
        if not conditions:
            raise ValueError(f"no condition in {clause!r}")
        rules.append((conditions, action, arg.strip()))
    if not rules:
        raise ValueError("no clause")
    return rules


def _condition(text: str) -> Column:
    """The predicate of a condition; an unknown one, or one with a value too many or too few, fits nothing."""
    found = re.fullmatch(r"([^=~]*)([=~]?)(.*)", text, re.S)
    name, value = (found[1].strip().lower() + found[2]), found[3].strip()
    if name in RELATED:
        return F.coalesce(F.col(f"__{name}"), F.lit(False))
    if name not in CONDITIONS or bool(found[2]) != bool(value) or (name == "min-size=" and not value.isdigit()):
        return F.lit(False)
    return F.coalesce(CONDITIONS[name](value), F.lit(False))


def related_ids(libraries: DataFrame, names: DataFrame, products: DataFrame, manuals: DataFrame, bases: DataFrame) -> dict[str, DataFrame]:
    """The ids of the libraries that meet each condition of ``RELATED``.

    duplicate: another library shares ``DUPLICATE`` of their names (library_id, name) together;
    unregistered: a container, but no product (reg_key) of its key (``product_key``); no-kb: manuals
    (library_id, name, ext, size_bytes, is_primary, mtime), of whose best no base (library_id, manual_name,
    built) is as new. Each is a join on the id or key.
    """
    from sonaria.functions.scalars import best_manual_score
    from sonaria.operators.relational import similar_pairs

    pairs = similar_pairs(names.select("library_id", F.lower("name").alias("name")), "library_id", "name", DUPLICATE)
    score = best_manual_score(F.col("name"), F.col("ext"), F.col("size_bytes"), F.col("is_primary"))
    best = manuals.groupBy("library_id").agg(F.min(F.struct((-score).alias("s"), "name", "mtime")).alias("m")).select("library_id", F.col("m.name").alias("manual_name"), "m.mtime")
    fresh = best.join(bases, ["library_id", "manual_name"]).where(F.col("built") >= F.col("mtime"))
    return {
        "duplicate": pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(),
        "unregistered": libraries.where("has_nicnt").join(products.select(F.lower("reg_key").alias("k")).distinct(), F.lower(F.coalesce("product_key", F.lit(""))) == F.col("k"), "left_anti").select("id"),
        "no-kb": best.join(fresh.select("library_id"), "library_id", "left_anti").select(F.col("library_id").alias("id")),
    }


def batch_rules(libraries: DataFrame, rules: list[tuple[list[str], str, str]], related: dict[str, DataFrame] | None = None) -> DataFrame:
    """library id, action, arg, reason: the first reason of each operation, from rules given as
    (conditions that must all hold, action, argument). Of the conditions on other tables only those that
    the rules name are joined; without ``related`` they fit nothing."""
    named = {re.sub("[=~].*", "", c).strip().lower() for conditions, _, _ in rules for c in conditions}
    rows = libraries
    for name in RELATED:
        if related and name in named:
            rows = rows.join(related[name].select("id").distinct().withColumn(f"__{name}", F.lit(True)), "id", "left")
        else:
            rows = rows.withColumn(f"__{name}", F.lit(False))
    parts = []
    for order, (conditions, action, arg) in enumerate(rules):
        fits = reduce(lambda a, b: a & b, map(_condition, conditions))
        parts.append(F.struct(fits.alias("fits"), F.lit(order).alias("rule"), F.lit(action).alias("action"), F.lit(arg).alias("arg"), F.lit(" and ".join(conditions)).alias("reason")))
    ops = rows.select("id", F.explode(F.filter(F.array(*parts), lambda p: p["fits"])).alias("op"))
    first = F.min(F.struct("op.rule", "op.reason"))["reason"]
    return ops.groupBy("id", F.col("op.action").alias("action"), F.col("op.arg").alias("arg")).agg(first.alias("reason"))


def issues(libraries: DataFrame, junk: DataFrame, manuals: DataFrame) -> DataFrame:
    """id, issue, detail of four checks: junk, no manual, unknown version, no cover."""
    dirty = junk.groupBy(F.col("library_id").alias("id")).agg(F.sum("size_bytes").alias("b")).where("b > 20000000").select("id", F.lit("junk").alias("issue"), F.col("b").alias("detail"))
    bare = libraries.join(manuals.select(F.col("library_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("no-manual").alias("issue"), F.lit(0).cast("long").alias("detail"))
    own = F.array(
        F.struct(((F.col("required_version") == "") & (F.col("nki_count") > 0)).alias("fits"), F.lit("unknown-version").alias("issue"), F.col("nki_count").cast("long").alias("detail")),
        F.struct((F.col("cover_file") == "").alias("fits"), F.lit("no-cover").alias("issue"), F.lit(0).cast("long").alias("detail")),
    )
    rest = libraries.select("id", F.explode(F.filter(own, lambda x: x["fits"])).alias("x")).select("id", "x.issue", "x.detail")
    return dirty.unionByName(bare).unionByName(rest)


def registration(libraries: DataFrame, products: DataFrame, records: DataFrame | None = None, managed: DataFrame | None = None) -> DataFrame:
    """id, reg_key, status of libraries (id, path, has_nicnt, and product_key where there is one).

    Products (reg_key, content_dir) whose content is the library's folder or lies below it make it
    ``registered``. Otherwise its own keys (``product_key``, split at semicolons, without the one to three
    letters or digits of a short mark unless nothing else is there) decide: none is ``non-standard``; any of them
    registered with content elsewhere ``path-mismatch``; none registered ``missing``. Without a column of keys
    containers are missing and others non-standard. Products with a column ``in64`` that is true for none of a
    library's make it ``partial``. Content belongs to the nearest library above it. A container's registered keys must all have a
    record (``records``: reg_key), else it is ``incomplete``; and where a manager's list is given (``managed``:
    reg_key), a registered or incomplete library none of whose keys it holds is ``pending-manager``. Keys are
    compared without case. A key with several products counts as the one with the smallest content.
    """
    from sonaria.operators.relational import longest_prefix

    low = lambda c: F.lower(F.trim(F.col(c)))
    own_keys = F.filter(F.transform(F.split(F.coalesce(F.col("product_key"), F.lit("")), ";"), lambda k: F.trim(k)), lambda k: k != "") if "product_key" in libraries.columns else F.array().cast("array<string>")
    real = F.filter(own_keys, lambda k: ~k.rlike("^[A-Za-z0-9]{1,3}$"))
    keyed = libraries.select("id", "path", "has_nicnt", F.when(F.size(real) > 0, F.array_distinct(real)).otherwise(F.slice(own_keys, 1, 1)).alias("keys"))
    owned = longest_prefix(products, "content_dir", libraries.select("id", "path"), "path")
    view = F.max(F.coalesce(F.col("in64"), F.lit(False))) if "in64" in products.columns else F.lit(True)
    here = owned.groupBy("id").agg(F.array_sort(F.collect_set("reg_key")).alias("here"), view.alias("in64"))
    named = products.groupBy(low("reg_key").alias("k")).agg(F.min("content_dir").alias("dir"))
    elsewhere = keyed.select("id", F.explode("keys").alias("key")).withColumn("k", low("key")).join(named, "k").groupBy("id").agg(F.min("key").alias("moved"))
    rows = keyed.join(here, "id", "left").join(elsewhere, "id", "left")
    status = (
        F.when(F.col("here").isNotNull() & ~F.col("in64"), "partial")
        .when(F.col("here").isNotNull(), "registered")
        .when(F.size("keys") == 0 if "product_key" in libraries.columns else ~F.col("has_nicnt"), "non-standard")
        .when(F.col("moved").isNotNull(), "path-mismatch")
        .otherwise("missing")
    )
    rows = rows.select("id", "has_nicnt", F.coalesce(F.get("here", F.lit(0)), F.col("moved")).alias("reg_key"), "here", status.alias("status"))
    for table, name in ((records, "with_record"), (managed, "in_list")):
        if table is not None:
            known = rows.select("id", F.explode("here").alias("key")).withColumn("k", low("key")).join(table.select(low("reg_key").alias("k")).distinct(), "k").groupBy("id").agg(F.count("*").alias(name))
            rows = rows.join(known, "id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    if records is not None:
        short = F.col("has_nicnt") & F.col("status").isin("registered", "partial") & (F.col("with_record") < F.size("here"))
        rows = rows.withColumn("status", F.when(short, "incomplete").otherwise(F.col("status")))
    if managed is not None:
        pending = F.col("status").isin("registered", "incomplete") & (F.col("in_list") == 0)
        rows = rows.withColumn("status", F.when(pending, "pending-manager").otherwise(F.col("status")))
    return rows.select("id", "reg_key", "status")


def misplaced(products: DataFrame) -> DataFrame:
    """Products in the 32-bit or the user's view but not in the 64-bit one."""
    return products.where(~F.col("in64") & (F.col("in32") | F.col("in_user")))


def suggestions(libraries: DataFrame, related: dict[str, DataFrame], pairs: DataFrame, groups: DataFrame | None = None, samples: int = 8) -> DataFrame:
    """kind, n, weight, samples: one row per rule that finds something, heaviest first.

    libraries (id, name, category, has_nicnt, cover_file, junk_bytes) are read once for six rules, with the ids of
    ``related`` (``unregistered`` and ``no-kb`` as ``related_ids`` gives them) beside them. ``similar`` counts pairs
    (a, b, jaccard), ``duplicates`` groups (library, reclaimable) of equal files, which are left out where none are
    given. A weight is the rule's own plus what it counts: mebibytes for junk and duplicates, rows for the others.
    Samples are the first names: by junk the largest, by pairs the most alike, a then b, each once; otherwise by
    name. Equal ones come by name.
    """
    from sonaria.operators.relational import first_rows

    flag = lambda name: related[name].select("id").distinct().withColumn(f"__{name}", F.lit(True))
    rows = libraries.join(flag("unregistered"), "id", "left").join(flag("no-kb"), "id", "left")
    junk, none, name = F.coalesce(F.col("junk_bytes"), F.lit(0)), F.lit(0).cast("long"), F.coalesce(F.col("name"), F.lit(""))
    rules = [
        ("register", F.col("__unregistered"), none), ("kb", F.col("__no-kb"), none), ("junk", junk > JUNK_BYTES, junk),
        ("cover", F.col("has_nicnt") & (F.coalesce(F.col("cover_file"), F.lit("")) == ""), none), ("nonstandard", ~F.col("has_nicnt"), none),
        ("unclassified", F.trim(F.coalesce(F.col("category"), F.lit(""))) == "", none),
    ]
    parts = [F.struct(F.lit(k).alias("kind"), F.coalesce(fits, F.lit(False)).alias("fits"), size.cast("long").alias("size")) for k, fits, size in rules]
    found = rows.select(name.alias("name"), F.explode(F.filter(F.array(*parts), lambda p: p["fits"])).alias("p")).select("p.kind", "name", "p.size")
    counts = found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    made = [counts.withColumn("m", F.when(F.col("kind") == "junk", F.floor(F.col("size") / (1 << 20))).otherwise(F.col("n"))).select("kind", "n", "m")]
    place = lambda *c: F.struct(*c)
    firsts = first_rows(found.withColumn("o", place((-F.col("size")).alias("a"), F.col("name").alias("b"))), ["kind"], "o", samples).select("kind", "o", "name")
    of = lambda side: libraries.select(F.col("id").alias(side), name.alias(f"name_{side}"))
    ranked = pairs.select("a", "b", "jaccard").withColumn("kind", F.lit("similar")).withColumn("o", place((-F.col("jaccard")).alias("j"), "a", "b"))
    few = first_rows(ranked, ["kind"], "o", samples).join(of("a"), "a").join(of("b"), "b")
    sides = few.select("kind", F.explode(F.array(F.struct(F.lit(0).alias("s"), "o", F.col("name_a").alias("name")), F.struct(F.lit(1).alias("s"), "o", F.col("name_b").alias("name")))).alias("x")).where("x.name <> ''")
    once = sides.groupBy("kind", "x.name").agg(F.min(F.struct("x.s", "x.o")).alias("o"))
    made.append(pairs.agg(F.count("*").alias("n")).select(F.lit("similar").alias("kind"), "n", F.col("n").alias("m")))
    lists = [firsts, once]
    if groups is not None:
        made.append(groups.agg(F.count("*").alias("n"), F.floor(F.coalesce(F.sum("reclaimable"), F.lit(0)) / (1 << 20)).alias("m")).select(F.lit("duplicates").alias("kind"), "n", "m"))
        large = groups.select(F.lit("duplicates").alias("kind"), place((-F.col("reclaimable")).alias("r"), "library", "fp").alias("o"), F.col("library").alias("name"))
        lists.append(first_rows(large, ["kind"], "o", 5).select("kind", "o", "name"))
    texts = [x.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda y: y["name"]), ",").alias("samples")) for x in lists]  # a few rows a kind
    union = lambda a, b: a.unionByName(b)
    base = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("kind")]
    out = reduce(union, made).where("n > 0").join(reduce(union, texts), "kind", "left")
    return out.select("kind", "n", (base + F.col("m")).cast("long").alias("weight"), F.coalesce("samples", F.lit("")).alias("samples")).orderBy(F.desc("weight"), "kind")


#: What a step of a plan can be; any other status is the first of these.
STATES = ("pending", "doing", "done", "blocked")
STEPS = 20


def plan_steps(text: Column, most: int = STEPS) -> Column:
    """array<struct<title, status>> of a JSON array of steps, each a text or an object, in their order, ``most`` at most.

    Texts are pending. Objects without a title are left out, and so is what is neither; titles and states are trimmed.
    Null and what is no JSON array have no steps.
    """
    steps = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    word = lambda x, path: F.trim(F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")))
    kind = lambda x, name: F.startswith(F.schema_of_variant(x), F.lit(name))
    state = lambda x: F.when(word(x, "$.status").isin(*STATES), word(x, "$.status")).otherwise(STATES[0])
    made = lambda x: F.when(kind(x, "STRING"), F.struct(word(x, "$").alias("title"), F.lit(STATES[0]).alias("status"))).when(kind(x, "OBJECT") & (word(x, "$.title") != ""), F.struct(word(x, "$.title").alias("title"), state(x).alias("status")))
    return F.slice(F.array_compact(F.transform(steps, made)), 1, most)


def missing_keys(args: Column, required: Column) -> Column:
    """The required keys that a JSON object lacks; all of them where it is no object."""
    return F.array_sort(F.array_except(required, F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))))


def suffix_repeats(text: Column, size: int = 160) -> Column:
    """How often a text's last characters occur in it, overlapping ones included."""
    tail = F.replace(F.right(text, F.lit(size)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_count(text, F.concat(F.lit("(?=\\Q"), tail, F.lit("\\E)")))


#: The characters of an end, and how often it stands in a text that repeats itself.
TAIL, STUCK = 160, 4


def suffix_stuck(text: Column, size: int = TAIL, times: int = STUCK) -> Column:
    """Whether a text's last ``size`` characters stand in it ``times`` times or more, overlapping ones included.

    A text of fewer than ``size * times`` characters is not stuck, nor is a null one. Each search begins after
    the place that the last one found, so a text is read once.
    """
    tail = F.right(text, F.lit(size))
    step = lambda at, _: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(F.position(tail, text, at + 1), F.lit(0)), F.lit(-1)))
    return F.coalesce((F.char_length(text) >= size * times) & (F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0), step) > 0), F.lit(False))


def snapshots(files: DataFrame) -> DataFrame:
    """name, created_at, reason, products, portable of snapshots (name, size_bytes, modified, content), the newest name first.

    A snapshot's JSON counts its products over all views. One whose content cannot be read stays in the list, with
    the time of its file, no reason and no products.
    """
    form = "created_at string, reason string, registry map<string, map<string, map<string, string>>>, settings string"
    rows = files.withColumn("s", F.from_json("content", form))
    views = F.coalesce(F.map_values("s.registry"), F.array().cast("array<map<string, map<string, string>>>"))
    products = F.aggregate(views, F.lit(0), lambda n, v: n + F.coalesce(F.size(F.map_keys(v)), F.lit(0)))
    return rows.select("name", F.coalesce("s.created_at", "modified").alias("created_at"), F.coalesce("s.reason", F.lit("")).alias("reason"), F.greatest(F.lit(0), products).cast("long").alias("products"), F.coalesce(F.col("s.settings").isNotNull(), F.lit(False)).alias("portable")).orderBy(F.desc("name"))


def manuals_status(libraries: DataFrame, manuals: DataFrame, bases: DataFrame) -> DataFrame:
    """id, name, manuals, best, built, listed of every library: its manuals' number, the best of them, whether the base
    of that one is as new, and its first eight (primary first, then the largest, then by name).

    manuals (library_id, name, ext, size_bytes, is_primary, mtime); bases (library_id, manual_name, built). Manuals of
    equal score come by name. A library without manuals has none, no best and no base.
    """
    from sonaria.functions.scalars import best_manual_score
    from sonaria.operators.relational import first_rows

    score = best_manual_score(F.col("name"), F.col("ext"), F.col("size_bytes"), F.col("is_primary"))
    per = manuals.groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("manuals"), F.min(F.struct((-score).alias("s"), "name", "mtime")).alias("m"))
    best = per.select("id", "manuals", F.col("m.name").alias("best"), F.col("m.mtime").alias("mtime"))
    newest = bases.groupBy(F.col("library_id").alias("id"), F.col("manual_name").alias("best")).agg(F.max("built").alias("at"))
    placed = manuals.select(F.col("library_id").alias("id"), F.struct((~F.col("is_primary")).alias("p"), (-F.col("size_bytes")).alias("s"), "name", F.col("id").alias("m")).alias("o"))
    first = first_rows(placed, ["id"], "o", 8).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["name"]).alias("listed"))  # eight a library
    rows = libraries.select("id", "name").join(best, "id", "left").join(newest, ["id", "best"], "left").join(first, "id", "left")
    return rows.select("id", "name", F.coalesce("manuals", F.lit(0)).alias("manuals"), F.coalesce("best", F.lit("")).alias("best"), F.coalesce(F.col("at") >= F.col("mtime"), F.lit(False)).alias("built"), F.coalesce("listed", F.array().cast("array<string>")).alias("listed"))


def manuals_totals(status: DataFrame) -> DataFrame:
    """libraries, manuals, built, missing of ``manuals_status``, and whether the list is so long that names alone are shown."""
    missing = ~F.col("built") & (F.col("manuals") > 0)
    return status.agg(F.count("*").alias("libraries"), F.coalesce(F.sum("manuals"), F.lit(0)).alias("manuals"), F.count_if("built").alias("built"), F.count_if(missing).alias("missing"), (F.count("*") > 60).alias("compact"))
