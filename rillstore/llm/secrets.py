"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds find spans by pattern. The method then hashes every candidate value (base values and long mixed
tokens), counts the distinct repositories and owners in which each hash occurs over the whole corpus, and calls
a candidate `copied` when more than `max_owners` owners or more than `max_repos` repositories have it, else `owned`:
an example that one owner has pasted into many repositories is no live credential. Mixed tokens that are owned are
added as spans of kind `owned`; base spans always stay.

Defined cases: a null text is scanned as an empty one; a null repository or owner counts as one unnamed value;
repeated rows are separate rows, and doc_id need not be unique or non-null; spans of one start are in the order of the kinds;
texts of any length are scanned whole, in time that grows with the square of the matches in one text; extra columns are ignored,
and a kept column with the name of a result is called kept_<name>; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, named, packed, unpacked

# The patterns of the base kinds. Group 2 of `assign` is the value.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _spans(text: Column, rank: int, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches with their places: lengths of the gaps between matches and of the matches, summed up."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))
        good = x["hit"].isNotNull() & (F.char_length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, nothing, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds, sorted by start, then kind."""
    return F.array_sort(F.concat(_spans(text, 0, ASSIGN, 2, 6), _spans(text, 1, ACCESS), _spans(text, 2, HEX)))


def mixed_tokens(text: Column, base: Column) -> Column:
    """Long tokens of upper- and lower-case letters and several digits that overlap no base span."""
    def fits(x: Column) -> Column:
        v = x["value"]
        mixed = v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9].*[0-9].*[0-9]")
        return mixed & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    return F.filter(_spans(text, 3, MIXED), fits)


def text_of(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Per candidate hash (columns hash, owner, repo): how many owners and repositories have it. Each step combines before its shuffle, so a hash in a third of all rows stays cheap."""
    once = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen"))


#: Owners and repositories that an owned value may have at most.
MAX_OWNERS, MAX_REPOS = 1, 5
RESULTS = ("base", "spans", "n_owned", "n_copied", "most_owners", "most_repos")


def scan(docs: DataFrame, keep: list[str], repo: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: the columns of `keep`, base (spans), spans (all), n_owned, n_copied, most_owners, most_repos.

    The owner is the part of the repository's name before the first slash. The last two are the most owners and repositories
    that any candidate of the text has, 0 without candidates.
    """
    return unpacked(_scan(docs, keep, repo, max_owners, max_repos, RESULTS), keep, *RESULTS)


def _scan(docs: DataFrame, keep: list[str], repo: str, max_owners: int, max_repos: int, results: tuple[str, ...] = ()) -> DataFrame:
    """As scan(), with the columns of `keep` in a struct."""
    # The repository's name is a plain string here; a null is an empty one.
    name = F.coalesce(named(repo).cast("string"), F.lit(""))
    found = packed(docs.withColumn("_repo_of_scan", name), [*keep, "_repo_of_scan"], results)
    found = found.select(F.col("kept").dropFields("_repo_of_scan").alias("kept") if keep else F.struct(F.lit(0).alias("nothing")).alias("kept"), F.col("kept._repo_of_scan").alias("repo"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("kept", "repo", "text", base_spans(F.col("text")).alias("base"))
    found = found.select("kept", "repo", "base", mixed_tokens(F.col("text"), F.col("base")).alias("mixed"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))

    each = found.where((F.size("base") > 0) | (F.size("mixed") > 0)).select(
        "row", "repo", F.substring_index("repo", "/", 1).alias("owner"), F.explode(F.concat("base", "mixed")).alias("span"))
    each = each.withColumn("hash", F.sha2(F.col("span.value"), 256))
    # Written, so that the join has exchanges of its own and a value in a third of all rows is split among tasks.
    owners = materialize(ownership(each.select("hash", "owner", "repo")))
    judged = each.select("row", "hash", "span").join(owners, "hash").withColumn("owned", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    by_row = judged.groupBy("row").agg(
        F.count_if("owned").alias("n_owned"), F.count_if(~F.col("owned")).alias("n_copied"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"),
        F.collect_list(F.when(F.col("owned") & (F.col("span.rank") == 3), F.col("span"))).alias("added"))
    out = found.join(by_row, "row", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return out.select(
        "kept", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULTS[2:]])


def redact(docs: DataFrame, mark: str = "[secret]", repo: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Replace every span of the scan in the texts; n_chars, if there, follows. Columns and rows stay."""
    cols = docs.columns
    found = _scan(docs, cols, repo, max_owners, max_repos)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # Spans of different kinds may overlap: what an earlier one covered is not written again.
        gap = F.substring(F.col("kept.text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("kept.text"), acc["at"] + 1, F.char_length("kept.text")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)).otherwise(F.col("kept.text"))
    out = found.select("kept", "spans", text.alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in cols:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("new").cast(kind)).otherwise(F.col("kept").getField("n_chars"))
    return out.select(*[changed.get(c, F.col("kept").getField(c)).alias(c) for c in cols])
