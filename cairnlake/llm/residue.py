"""Template residue, filler, error pages and script notices in place of content.

The pages of a site follow one template; aligned by place, masked text and label, the lines of their main bodies are
the values of the template's slots. How the pages of the site fill a slot tells its defaults and blanks; variable names
and known phrases are checked in each value. Beside them stand whole-page templates, told by alignment across sites:
main bodies made of lines that, names and numbers aside, stand on several sites and mostly in bodies made of nothing
else; bodies that are the same so on several pages of several sites, or as they are on many pages of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.slots import HEADED, NONE, TAGGED
from cairnlake.session import written

#: Share of a main body's characters that say nothing, from which the page is a case.
NOTHING_SHARE = 0.5
#: Slots with variable names from which a page is a case; one is enough in a heading.
PLACES_FROM = 2
#: Sites on which a whole-page template stands.
TEMPLATE_SITES = 3
#: Pages of each of them on which one stands that no phrase is known from, and of a single site.
TEMPLATE_PAGES, LOCAL_PAGES = 3, 10
#: Share of a body's firm lines that shared lines take in a body that is closed.
CLOSED_SHARE = 0.9
#: Share of a template's characters that are not masked; below it the pages are different records of one form.
FIXED_SHARE = 0.5
#: A slot says something about its values from so many records; a value on so many pages may be its default.
SLOT_RECORDS, DEFAULT_PAGES = 8, 4
def flagged(bodies: DataFrame) -> DataFrame:
    """``site, slot, value``: values that are a default or blank, told by how the site's pages fill the slot.

    A slot whose values are mostly different from page to page takes a value that stands on many pages for a default.
    A slot that is mostly filled is blank where it is not. Pages are counted by address: a page that was captured
    again with another content counts once.
    """
    sited = bodies.where("site IS NOT NULL")
    unit = sited.select("site", "page", F.explode("units").alias("u")).select("site", "page", "u.slot", "u.value")
    per = unit.distinct().groupBy("site", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("value") == NONE
    slot = per.groupBy("site", "slot").agg(
        F.sum("n").alias("records"), F.sum(F.when((F.col("n") == 1) & ~blank, 1).otherwise(0)).alias("single"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blanks")
    )
    total = sited.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    slot = slot.where(F.col("records") >= SLOT_RECORDS).join(total, "site")
    default = ~blank & (F.col("n") >= DEFAULT_PAGES) & (2 * F.col("n") <= F.least("records", "pages")) & (2 * F.col("single") >= F.col("records"))
    missing = blank & (4 * F.col("blanks") <= F.col("records"))
    many = per.where(blank | (F.col("n") >= DEFAULT_PAGES))  # no other can be flagged
    return many.join(slot, ["site", "slot"]).where(default | missing).select("site", "slot", "value")


SLOTS = ("content_id", "site", "page", "places", "in_heading", "nothing", "defaults", "blanks", "lines", "template", "fixed", "whole")


def slots(bodies: DataFrame) -> DataFrame:
    """What the slots of each main body hold: places, the shares that say nothing and that are defaults or say nothing,
    blank slots, slots in all, and the hashes of the body masked and as it stands."""
    unit = bodies.where("site IS NOT NULL").select("content_id", "site", F.explode("units").alias("u")).select("content_id", "site", "u.*")
    line = unit.join(flagged(bodies), ["site", "slot", "value"], "left_semi").groupBy("content_id", "site", "line").agg(
        F.max("size").alias("size"), F.max("extra").alias("extra"), F.max("by").alias("by"), F.max(F.col("value") == NONE).alias("blank")
    )
    # By their tags alone bylines and notices look like defaults too: those count where the heading is one.
    head = line.groupBy("content_id", "site").agg((F.max("by") == HEADED).alias("head"))
    line = line.join(head, ["content_id", "site"]).where(F.col("head") | (F.col("by") != TAGGED))
    hit = line.groupBy("content_id", "site").agg(
        F.sum(F.when(~F.col("blank"), F.col("size")).otherwise(0)).alias("default"), F.sum("extra").alias("extra"), F.sum(F.col("blank").cast("int")).alias("blanks")
    )
    both = bodies.select("content_id", "site", "page", "places", "in_heading", "empty", "total", "template", "fixed", "whole", "lines")
    default = F.coalesce("default", F.lit(0))
    share = lambda x, of: F.when(F.col(of) > 0, x / F.col(of)).otherwise(0.0)
    joined = both.join(hit, ["content_id", "site"], "left").withColumn("chars", F.col("total") + F.coalesce("extra", F.lit(0)))
    joined = joined.withColumn("nothing", share(F.col("empty"), "total")).withColumn("defaults", share(F.col("empty") + default, "chars"))
    return joined.withColumn("blanks", F.coalesce("blanks", F.lit(0))).select(*SLOTS)


def closed_templates(bodies: DataFrame) -> DataFrame:
    """``content_id`` of the bodies made of template lines, without any phrase known.

    A line (names, numbers and paths masked, mostly fixed text) may belong to a template if it stands on
    ``TEMPLATE_SITES`` sites. It does if at least half of the bodies with it are made of such lines nearly alone: the
    lines of an error page keep to themselves, while a sentence that happens to stand on several sites stands among
    others that do not. A body is a case if half of its characters are in template lines. Null sites count for nothing.
    """
    line = bodies.where("site IS NOT NULL").select("content_id", "site", "page", "own_size", F.inline("masks"))
    per = line.select("mask", "site", "page").distinct().groupBy("mask", "site").agg(F.count(F.lit(1)).alias("pages"))
    may = per.groupBy("mask").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= TEMPLATE_SITES).select("mask", F.lit(True).alias("shared"))
    # One row per body with its lines: bounded by a page.
    lines = F.collect_list(F.struct("mask", "size", F.coalesce("shared", F.lit(False)).alias("shared")))
    body = line.join(may, "mask", "left").groupBy("content_id", "site").agg(lines.alias("lines"), F.max("own_size").alias("own_size"))
    size = lambda x, keep=None: F.aggregate(F.filter(x, keep) if keep else F.col(x), F.lit(0), lambda s, l: s + l["size"])
    body = body.withColumn("firm", size("lines")).withColumn("closed", size("lines", lambda l: l["shared"]) >= CLOSED_SHARE * F.col("firm"))
    body = written(body, "line-templates")  # read twice below
    each = body.select("content_id", "site", "closed", "firm", "own_size", F.inline("lines")).where("shared")
    kept = each.select("content_id", "site", "mask", "closed").distinct().groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("closed").alias("c")).where(2 * F.col("c") >= F.col("n"))
    hit = each.join(kept.select("mask"), "mask", "left_semi").groupBy("content_id", "site").agg(F.sum("size").alias("size"), F.max("firm").alias("firm"), F.max("own_size").alias("own_size"))
    return hit.where(F.col("size") >= NOTHING_SHARE * F.greatest("firm", F.col("own_size") * NOTHING_SHARE)).select("content_id")


def found(bodies: DataFrame) -> DataFrame:
    """``content_id`` of the contents whose main body is residue, filler, an error or a notice.

    Contents without lines are no cases. Quoted messages, samples in code and a single place in a sentence are none
    either. A body that stands, names and numbers aside, on several pages each of several sites, or as it is on many
    pages of one, is a whole-page template; one that part of says nothing needs only the sites.
    """
    s = written(slots(bodies), "slots")  # read four times below
    own = (F.col("places") >= PLACES_FROM) | F.col("in_heading") | (F.col("nothing") >= NOTHING_SHARE)
    own |= (F.col("defaults") >= NOTHING_SHARE) | (F.col("blanks") >= PLACES_FROM) & (2 * F.col("blanks") >= F.col("lines"))
    partly = s.where((F.col("template") != 0) & (F.col("nothing") >= NOTHING_SHARE / 2))
    shared = partly.groupBy("template").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= TEMPLATE_SITES)
    repeated = partly.join(shared, "template", "left_semi").select("content_id")
    fixed = s.where((F.col("template") != 0) & (F.col("fixed") >= FIXED_SHARE) & F.col("site").isNotNull())

    def pages(key: str) -> DataFrame:
        return fixed.select(key, "site", "page").distinct().groupBy(key, "site").agg(F.count(F.lit(1)).alias("pages"))

    wide = pages("template").where(F.col("pages") >= TEMPLATE_PAGES).groupBy("template").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= TEMPLATE_SITES)
    local = pages("whole").where(F.col("pages") >= LOCAL_PAGES).select("whole", "site")
    templates = fixed.join(wide, "template", "left_semi").select("content_id").unionByName(fixed.join(local, ["whole", "site"], "left_semi").select("content_id"))
    return s.where(own).select("content_id").unionByName(repeated).unionByName(templates).unionByName(closed_templates(bodies)).distinct()
