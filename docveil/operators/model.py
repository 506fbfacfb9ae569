"""The ordered file and page model, as tables.

files: (model, iid, pos, path, kind, enc_key, creation_date, name_date,
size_bytes, origin_iid, source_page_count, pages_loaded); pages: (model, uid,
iid, pos, src_path, src_index, rotation, ...). Order is a column; every window is
within a model, so many models are worked on side by side. Missing dates and parents are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "jpg", "jpeg", "png", "bmp", "tiff", "tif")
KEYS = ("model", "iid")


def kind_for_path(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("image")


def is_supported(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SUFFIXES)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _rank(table: DataFrame, order: list, by: tuple[str, ...] = ("model",), out: str = "pos") -> DataFrame:
    return table.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


# --- reading -----------------------------------------------------------


def add_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """new files behind the old ones; a path that is there already, or comes twice, is ignored."""
    first = _rank(new, ["pos"], ("model", "path"), "__n").where("__n = 0").drop("__n")
    fresh = first.join(files.select("model", "path"), ["model", "path"], "left_anti")
    both = files.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return _rank(both, ["__new", "pos"]).drop("__new")


def populate_pages(files: DataFrame) -> DataFrame:
    """A row for each page of a file; an image has one, a file of unknown length none."""
    n = F.when(F.col("kind") == "image", 1).otherwise(F.coalesce("source_page_count", F.lit(0)))
    index = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < F.col("__n"))
    made = files.withColumn("__n", n).select("model", "iid", F.col("path").alias("src_path"), F.explode(index).alias("src_index"))
    return made.select("model", F.concat_ws("#", "iid", "src_index").alias("uid"), "iid", F.col("src_index").alias("pos"), "src_path", "src_index", F.lit(0).alias("rotation"))


def output_plan(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages in the order of files, then of pages, with out_pos; files without loaded pages are left out."""
    titled = files.where("pages_loaded").select("model", "iid", F.col("pos").alias("file_pos"), base_name(F.col("path")).alias("file_title"))
    return _rank(pages.join(titled, list(KEYS)), ["file_pos", "pos"], out="out_pos")


def ordered_pages(files: DataFrame, pages: DataFrame, uids: DataFrame) -> DataFrame:
    """The named pages in the model's order."""
    return output_plan(files, pages).join(uids.select("model", "uid").distinct(), ["model", "uid"], "left_semi")


def page_scope(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected pages of a model if they are two or more, else all of its pages."""
    many = selected.groupBy("model").agg(F.count_distinct("uid").alias("n")).where("n >= 2")
    chosen = pages.join(selected.select("model", "uid").distinct(), ["model", "uid"], "left_semi").join(many, "model", "left_semi")
    return chosen.unionByName(pages.join(many, "model", "left_anti"))


def scan_jobs(files: DataFrame, pages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(model, uid, src_path, src_index, label, job): labels count all pages of a file, then pages are chosen and ordered by source."""
    plan = output_plan(files, pages)
    labelled = _rank(plan, ["pos"], KEYS, "__n").withColumn("label", F.concat(F.col("file_title"), F.lit(" · side "), F.col("__n") + 1))
    if only is not None:
        labelled = labelled.join(only.select("model", "uid"), ["model", "uid"], "left_semi")
    return _rank(labelled, [F.lower("src_path"), "src_index", "uid"], out="job").select("model", "uid", "src_path", "src_index", "label", "job")


def unscanned(pages: DataFrame, scanned: DataFrame) -> DataFrame:
    return pages.join(scanned.select("model", "uid"), ["model", "uid"], "left_anti")


def files_touched(files: DataFrame, pages: DataFrame, uids: DataFrame) -> DataFrame:
    """Files of which any page is named."""
    hit = pages.join(uids.select("model", "uid"), ["model", "uid"], "left_semi")
    return files.join(hit.select(*KEYS).distinct(), list(KEYS), "left_semi")


def page_label(path: Column, src_path: Column, src_index: Column, pos: Column) -> Column:
    """The source's number of an own page, '+place' of a foreign one."""
    return F.when(F.lower(src_path) == F.lower(path), (src_index + 1).cast("string")).otherwise(F.concat(F.lit("+"), (pos + 1).cast("string")))


def page_totals(files: DataFrame, pages: DataFrame) -> DataFrame:
    """files with n_pages: those loaded, else one for an image, else what the source says."""
    n = pages.groupBy(*KEYS).agg(F.count("*").alias("__loaded"))
    total = F.when(F.col("pages_loaded"), F.coalesce("__loaded", F.lit(0))).when(F.col("kind") == "image", 1).otherwise(F.coalesce("source_page_count", F.lit(0)))
    return files.join(n, list(KEYS), "left").withColumn("n_pages", total.cast("long")).drop("__loaded")


def pages_text(kind: Column, loaded: Column, n_loaded: Column, source_count: Column, view: bool = True) -> Column:
    """How many pages, as text: of an image that is not loaded '1' in the view and '' in the model."""
    return F.when(loaded, n_loaded.cast("string")).when(kind == "image", F.lit("1" if view else "")).otherwise(F.coalesce(F.nullif(source_count, F.lit(0)).cast("string"), F.lit("")))


def status_totals(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(model, n_files, n_pages)."""
    return page_totals(files, pages).groupBy("model").agg(F.count("*").alias("n_files"), F.sum("n_pages").alias("n_pages"))


def image_pages(pages: DataFrame) -> DataFrame:
    return pages.where(kind_for_path(F.col("src_path")) == "image")


def ocr_jobs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct source pages, and which pages each serves: the work is done once and fanned out by a join."""
    keyed = pages.withColumn("src_key", F.lower("src_path"))
    return keyed.groupBy("src_key", "src_index").agg(F.min("src_path").alias("src_path")), keyed.select("model", "uid", "src_key", "src_index")


def apply_hits(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Search hits (src_path, src_index, ...) on every page that shows the source page."""
    keyed = hits.withColumn("src_key", F.lower("src_path")).drop("src_path")
    return pages.withColumn("src_key", F.lower("src_path")).join(keyed, ["src_key", "src_index"]).drop("src_key")


# --- runs --------------------------------------------------------------


def _islands(table: DataFrame, new: Column, by: tuple[str, ...], out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pos")
    return table.withColumn("__new", F.coalesce(new.cast("int"), F.lit(1))).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def source_runs(pages: DataFrame) -> DataFrame:
    """pages with src_run: maximal runs of one source within a file."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    return _islands(pages, F.lower("src_path") != F.lag(F.lower("src_path")).over(w), KEYS, "src_run")


def index_runs(pages: DataFrame) -> DataFrame:
    """pages with run: maximal runs of one source whose indexes rise by one."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    goes_on = (F.col("src_index") == F.lag("src_index").over(w) + 1) & (F.lower("src_path") == F.lag(F.lower("src_path")).over(w))
    return _islands(pages, ~goes_on, KEYS, "run")


def file_jobs(files: DataFrame, pages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(model, iid, src_run, path, kind, enc_key, title, n_pages, out_job): what a save does, one row for each run of a source."""
    if only is not None:
        pages = pages.join(only.select("model", "uid"), ["model", "uid"], "left_semi")
    runs = source_runs(pages).groupBy(*KEYS, "src_run").agg(F.min_by("src_path", "pos").alias("src_path"), F.count("*").alias("n_pages"))
    loaded = files.where("pages_loaded").join(runs, list(KEYS))
    own = F.lower("src_path") == F.lower("path")
    rows = loaded.select("model", "iid", "src_run", F.col("src_path").alias("job_path"), F.when(own, F.col("kind")).otherwise(kind_for_path(F.col("src_path"))).alias("kind"), F.when(own, F.col("enc_key")).otherwise(F.lit("not_encrypted")).alias("enc_key"), base_name(F.col("src_path")).alias("title"), "n_pages", F.col("pos").alias("file_pos"))
    if only is None:
        whole = files.where("NOT pages_loaded").select("model", "iid", F.lit(0).cast("long").alias("src_run"), F.col("path").alias("job_path"), "kind", "enc_key", base_name(F.col("path")).alias("title"), F.lit(None).cast("long").alias("n_pages"), F.col("pos").alias("file_pos"))
        rows = rows.unionByName(whole)
    return _rank(rows, ["file_pos", "src_run"], out="out_job").drop("file_pos")


def blocks(files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """files with block: a child stays with its parent's block right before it, unless it is chosen without its parent."""
    live = files.select("model", F.col("iid").alias("origin_iid"), F.lit(True).alias("__live"))
    want = chosen.select("model", "iid").distinct().withColumn("__want", F.lit(True)) if chosen is not None else files.limit(0).select("model", "iid", F.lit(True).alias("__want"))
    parents = want.select("model", F.col("iid").alias("origin_iid"), F.col("__want").alias("__parent_want"))
    tagged = files.join(live, ["model", "origin_iid"], "left").join(want, list(KEYS), "left").join(parents, ["model", "origin_iid"], "left")
    child = F.coalesce(F.col("__live"), F.lit(False)) & ~(F.coalesce(F.col("__want"), F.lit(False)) & ~F.coalesce(F.col("__parent_want"), F.lit(False)))
    start = F.struct(F.lit(None).cast("string").alias("head"), F.lit(-1).alias("n"), F.array().cast("array<struct<iid:string,block:int>>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        glued = F.coalesce(f["child"] & (acc["head"] == f["origin_iid"]), F.lit(False))
        n = F.when(glued, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(glued, acc["head"]).otherwise(f["iid"]).alias("head"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(f["iid"].alias("iid"), n.alias("block")))).alias("out"))

    # Whether a file is glued depends on the block before it, so the files of each model are folded in order.
    listed = tagged.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", "iid", "origin_iid", child.alias("child")))).alias("f"))
    placed = listed.select("model", F.explode(F.aggregate("f", start, step, lambda x: x["out"])).alias("o")).select("model", "o.*")
    out = tagged.join(placed, list(KEYS)).withColumn("chosen", F.coalesce("__want", F.lit(False)))
    return out.drop("__live", "__want", "__parent_want")


# --- ordering ----------------------------------------------------------


def _sort_value(key: str) -> list[Column]:
    return {
        "name": [F.lower(base_name(F.col("path")))], "size": [F.col("size_bytes")], "pages": [F.col("n_pages")],
        "date": [F.col("creation_date")], "name_date": [F.col("name_date")], "reverse": [],
    }[key]


def sort_files(files: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """files in a new order (pos).

    Children follow their parent in their old order, a dangling parent makes a
    root, a child of a child goes last. Missing dates are last both
    ways; descending, ties come in the reverse of their old order. For 'pages' the
    table needs n_pages.
    """
    turned = reverse or key == "reverse"
    parents = files.select("model", F.col("iid").alias("origin_iid"), F.col("pos").alias("__ppos"), F.col("origin_iid").alias("__grand"))
    alive = files.select("model", F.col("iid").alias("__grand"), F.lit(True).alias("__deep"))
    joined = files.join(parents, ["model", "origin_iid"], "left").join(alive, ["model", "__grand"], "left").drop("__grand")
    kid = F.col("__ppos").isNotNull()
    values = {f"__v{k}": v for k, v in enumerate(_sort_value(key))}
    roots = joined.where(~kid).withColumns(values)
    order = [F.desc_nulls_last(v) if turned else F.asc_nulls_last(v) for v in values]
    roots = _rank(roots, [*order, F.desc("pos") if turned else F.asc("pos")], out="__root")
    kids = joined.where(kid).join(roots.select("model", F.col("iid").alias("origin_iid"), "__root"), ["model", "origin_iid"], "left")
    both = roots.drop(*values).withColumn("__kid", F.lit(0)).unionByName(kids.withColumn("__kid", F.lit(1)))
    return _rank(both, [F.asc_nulls_last("__root"), "__kid", "pos"]).select(*files.columns)


def sort_within(files: DataFrame, key: str, reverse: bool, chosen: DataFrame) -> DataFrame:
    """Only the chosen blocks change places among themselves; missing dates last both ways."""
    grouped = blocks(files, chosen)
    heads = _rank(grouped, ["pos"], ("model", "block"), "__n").where("__n = 0").drop("__n")
    picked = heads.where("chosen").withColumns({f"__v{k}": v for k, v in enumerate(_sort_value(key))})
    values = [c for c in picked.columns if c.startswith("__v")]
    order = [F.desc_nulls_last(v) if reverse else F.asc_nulls_last(v) for v in values] + [F.desc("pos") if key == "reverse" else F.asc("pos")]
    slots = _rank(picked, ["pos"], out="__k").select("model", "__k", F.col("block").alias("__slot"))
    placed = _rank(picked, order, out="__k").join(slots, ["model", "__k"]).select("model", "block", "__slot")
    both = grouped.join(placed, ["model", "block"], "left")
    return _rank(both, [F.coalesce("__slot", "block"), "pos"]).select(*files.columns)


def power_sort_rows(rows: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """Rows ordered with missing values last, then by name and iid; with rank."""
    first = F.desc_nulls_last(key) if reverse else F.asc_nulls_last(key)
    return _rank(rows, [first, F.lower("name"), "iid"], out="rank")


def reorder_files(files: DataFrame, order: DataFrame) -> DataFrame:
    """order (model, iid, rank) first; files not named keep their order behind."""
    return _rank(files.join(order, list(KEYS), "left"), [F.asc_nulls_last("rank"), "pos"]).select(*files.columns)


def power_sort(files: DataFrame, order: DataFrame, dates: DataFrame | None) -> DataFrame:
    """reorder_files(), and name_date from dates (model, iid, name_date): a file not named loses its date; without dates they stay."""
    out = reorder_files(files, order)
    return out if dates is None else out.drop("name_date").join(dates, list(KEYS), "left").select(*files.columns)


def move_file(files: DataFrame, model: str, iid: str, index: int) -> DataFrame:
    """One file to another place, counted without it; beyond the ends it stops there."""
    moved = (F.col("model") == model) & (F.col("iid") == iid)
    rest = _rank(files.withColumn("__m", moved), ["__m", "pos"], out="__r")
    n = F.count(F.when(~F.col("__m"), 1)).over(Window.partitionBy("model"))
    at = F.greatest(F.lit(0), F.least(F.lit(index), n))
    return _rank(rest.withColumn("__at", F.when(F.col("__m"), at).otherwise(F.col("__r"))), ["__at", F.desc("__m")]).select(*files.columns)


def drop_file(files: DataFrame, model: str, iid: str, row: int) -> DataFrame:
    """A file and its children before the file now in that row; behind all where there is none; nothing where it is of the block itself."""
    here = F.col("model") == model
    own = here & ((F.col("iid") == iid) | F.coalesce(F.col("origin_iid") == iid, F.lit(False)))
    w = Window.partitionBy("model")
    tagged = files.withColumn("__own", own).withColumn("__first", F.when(F.col("iid") == iid, 0).otherwise(1))
    anchor = tagged.withColumn("__at", F.max(F.when(F.col("pos") == row, F.col("pos"))).over(w)).withColumn("__self", F.max(F.when(F.col("pos") == row, F.col("__own").cast("int"))).over(w))
    known = F.max((F.col("iid") == iid).cast("int")).over(w) == 1
    moves = here & known & F.coalesce(F.col("__self") == 0, F.lit(True))
    before = F.when(F.col("__own"), F.coalesce(F.col("__at"), F.lit(1 << 30)) * 2 - 1).otherwise(F.col("pos") * 2)
    return _rank(anchor.withColumn("__k", F.when(moves, before).otherwise(F.col("pos") * 2)).withColumn("__f", F.when(moves & F.col("__own"), F.col("__first")).otherwise(0)), ["__k", "__f", "pos"]).select(*files.columns)


def to_edge(files: DataFrame, chosen: DataFrame, to_end: bool) -> DataFrame:
    """The chosen blocks to one end; both parts keep their order."""
    first = F.col("chosen_block") if to_end else ~F.col("chosen_block")
    grouped = blocks(files, chosen)
    head = F.first("chosen").over(Window.partitionBy("model", "block").orderBy("pos"))
    return _rank(grouped.withColumn("chosen_block", head), [first, "pos"]).select(*files.columns)


def step_files(files: DataFrame, chosen: DataFrame, down: bool) -> DataFrame:
    """Each chosen block changes places with an unchosen neighbour in that direction; blocks gather at the edge in their order.

    Seen from the edge, a chosen block moves unless only chosen blocks lie
    ahead. Then each unchosen block that chosen ones pass comes behind their run.
    """
    grouped = blocks(files, chosen)
    heads = _rank(grouped, ["pos"], ("model", "block"), "__n").where("__n = 0").select("model", "block", "chosen")
    side = F.desc("block") if down else F.asc("block")
    w = Window.partitionBy("model").orderBy(side)
    seen = heads.withColumn("__k", F.row_number().over(w)).withColumn("__free", F.count_if(~F.col("chosen")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A run of chosen blocks moves one place ahead of the unchosen block before it.
    key = F.when(F.col("chosen"), F.greatest(F.col("__free") - 1, F.lit(0)) * 2 + F.when(F.col("__free") == 0, -1).otherwise(0)).otherwise((F.col("__free") - 1) * 2 + 1)
    placed = _rank(seen.withColumn("__key", key), ["__key", "__k"], out="__p").select("model", "block", "__p")
    place = F.desc("__p") if down else F.asc("__p")
    return _rank(grouped.join(placed, ["model", "block"]), [place, "pos"]).select(*files.columns)


# --- moving pages ------------------------------------------------------


def _drop_empty(files: DataFrame, pages: DataFrame, keep: Column) -> DataFrame:
    """Loaded files without a page go."""
    held = pages.select(*KEYS).distinct().withColumn("__held", F.lit(True))
    left = files.join(held, list(KEYS), "left").where(F.col("__held") | ~F.col("pages_loaded") | keep)
    return _rank(left, ["pos"]).select(*files.columns)


def move_pages(files: DataFrame, pages: DataFrame, uids: DataFrame, iid: str, position: int) -> tuple[DataFrame, DataFrame]:
    """The named pages, in the model's order, into a file at a position that is counted without them; emptied files go."""
    named = ordered_pages(files, pages, uids).select("model", "uid", "out_pos")
    joined = pages.join(named, ["model", "uid"], "left")
    moved = F.col("out_pos").isNotNull()
    target = joined.withColumn("__m", moved).withColumn("iid", F.when(moved, F.lit(iid)).otherwise(F.col("iid")))
    rest = _rank(target, ["__m", "pos"], KEYS, "__r")
    n = F.count(F.when(~F.col("__m"), 1)).over(Window.partitionBy(*KEYS))
    at = F.when(F.col("__m"), F.greatest(F.lit(0), F.least(F.lit(position), n))).otherwise(F.col("__r"))
    out = _rank(rest.withColumn("__at", at), ["__at", F.desc("__m"), "out_pos"], KEYS).select(*pages.columns)
    return _drop_empty(files, out, F.col("iid") == iid), out


def extract_pages(files: DataFrame, pages: DataFrame, uids: DataFrame, new_iid: str) -> tuple[DataFrame, DataFrame]:
    """The named pages as a file of their own behind the block of the root of the first one's file."""
    named = ordered_pages(files, pages, uids).select("model", "uid", "iid", "out_pos")
    mother = named.groupBy("model").agg(F.min_by("iid", "out_pos").alias("iid"))
    row = files.join(mother, list(KEYS), "left_semi").withColumn("origin_iid", F.coalesce("origin_iid", "iid")).withColumn("iid", F.lit(new_iid)).withColumn("pages_loaded", F.lit(True))
    joined = pages.join(named.select("model", "uid", "out_pos"), ["model", "uid"], "left")
    own = F.col("out_pos").isNotNull()
    out = _rank(joined.withColumn("iid", F.when(own, F.lit(new_iid)).otherwise(F.col("iid"))), [F.coalesce("out_pos", "pos")], KEYS).select(*pages.columns)
    root = row.select("model", F.col("origin_iid").alias("__root"))
    kin = files.join(root, "model", "left").withColumn("__kin", (F.col("iid") == F.col("__root")) | (F.col("origin_iid") == F.col("__root")))
    last = kin.where("__kin").groupBy("model").agg(F.max("pos").alias("__last"))
    both = files.withColumn("__new", F.lit(0)).withColumn("__at", F.col("pos")).unionByName(row.join(last, "model", "left").withColumn("__new", F.lit(1)).withColumn("__at", F.coalesce("__last", "pos")).drop("__last"))
    return _drop_empty(_rank(both, ["__at", "__new"]).select(*files.columns), out, F.lit(False)), out


def remove_pages(files: DataFrame, pages: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = _rank(pages.join(uids.select("model", "uid"), ["model", "uid"], "left_anti"), ["pos"], KEYS)
    return _drop_empty(files, left, F.lit(False)), left


def insert_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """new pages (model, iid, uid, src_path, src_index, rotation, at): each before the page now at its place."""
    both = pages.withColumn("at", F.col("pos")).withColumn("__new", F.lit(1)).unionByName(new.withColumn("pos", F.monotonically_increasing_id()).withColumn("__new", F.lit(0)))
    return _rank(both, ["at", "__new", "pos"], KEYS).select(*pages.columns)


def set_fields(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Whole fields replaced by changes (model, uid, rotation?, crop?, annots?); rotation is taken modulo 360."""
    fields = [c for c in changes.columns if c not in ("model", "uid")]
    renamed = changes.select("model", "uid", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in fields))
    out = pages.join(renamed, ["model", "uid"], "left")
    for c in fields:
        value = F.pmod(F.col(f"__{c}"), F.lit(360)) if c == "rotation" else F.col(f"__{c}")
        out = out.withColumn(c, F.when(F.col("__hit"), value).otherwise(F.col(c)))
    return out.select(*pages.columns)


def pages_moved(files: DataFrame, pages: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """(model, moved): some file was torn out of another, or a page lies in a file that is not its home."""
    homes = files.select("model", F.col("path").alias("src_path"))
    if retired is not None:
        homes = homes.unionByName(retired.select("model", F.col("path").alias("src_path")))
    strangers = pages.join(files.select("model", "iid", "path"), list(KEYS)).where("src_path <> path").join(homes.distinct(), ["model", "src_path"], "left_semi")
    hit = strangers.select("model").union(files.where("origin_iid IS NOT NULL").select("model")).distinct().withColumn("moved", F.lit(True))
    return files.select("model").distinct().join(hit, "model", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))


def retired_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that a change emptied; they remain the homes of their pages. Torn-out ones do not."""
    return before.where("origin_iid IS NULL").join(after.select(*KEYS), list(KEYS), "left_anti")


def reset_layout(files: DataFrame, pages: DataFrame, retired: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every page back in its home file: own pages by source index, inserted ones behind the page they followed.

    Homes are the files and those retired, which come back behind the others. A torn-out file whose
    home is unknown becomes the home. Files that lose and gain nothing keep their order.
    """
    if retired is not None:
        back = retired.join(files.where("origin_iid IS NULL").select("model", "path"), ["model", "path"], "left_anti")
        both = files.withColumn("__old", F.lit(0)).unionByName(back.select(*files.columns).withColumn("__old", F.lit(1)))
        files = _rank(both, ["__old", "pos"]).select(*files.columns)
    w = Window.partitionBy("model", "path").orderBy(F.col("origin_iid").isNotNull(), "pos")
    home = files.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("model", F.col("path").alias("home_path"), F.col("iid").alias("home_iid"))
    hosted = pages.join(files.select("model", "iid", F.col("path").alias("host_path"), F.col("pos").alias("file_pos"), F.col("origin_iid").isNotNull().alias("torn")), list(KEYS))
    source = home.withColumnsRenamed({"home_path": "src_path", "home_iid": "src_home"})
    host = home.withColumnsRenamed({"home_path": "host_path", "home_iid": "host_home"})
    joined = hosted.join(source, ["model", "src_path"], "left").join(host, ["model", "host_path"], "left")
    here = (F.col("host_path") == F.col("src_path")) & ~F.col("torn")
    target = F.when(here, F.col("iid")).otherwise(F.coalesce("src_home", F.when(F.col("torn"), F.col("host_home")).otherwise(F.col("iid"))))
    placed = joined.withColumn("to", target).withColumn("own", F.col("src_home").isNotNull())
    along = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("anchor", F.coalesce(F.last(F.when(F.col("own"), F.col("src_index")), ignorenulls=True).over(along), F.lit(-1)))
    each = Window.partitionBy("model", "to")
    calm = F.min((F.col("to") == F.col("iid")).cast("int")).over(each) == 1
    left = placed.where("to <> iid").select("model", F.col("iid").alias("to")).distinct().withColumn("__lost", F.lit(True))
    placed = placed.withColumn("__calm", calm).join(left, ["model", "to"], "left").withColumn("__calm", F.col("__calm") & F.col("__lost").isNull())
    key = [F.when(F.col("__calm"), F.col("pos")).otherwise(F.col("anchor")), F.when(F.col("__calm"), F.lit(0)).otherwise((~F.col("own")).cast("int")), "file_pos", "pos"]
    out = _rank(placed, key, ("model", "to"), "__pos").drop("iid", "pos").withColumnsRenamed({"to": "iid", "__pos": "pos"}).select(*pages.columns)
    kept = files.join(home.select("model", F.col("home_iid").alias("iid"), F.lit(True).alias("__home")), list(KEYS), "left")
    kept = kept.where(F.col("__home") | F.col("origin_iid").isNull()).withColumn("origin_iid", F.lit(None).cast("string")).select(*files.columns)
    return _drop_empty(kept, out, F.lit(False)), out


def plan_nudge(files: DataFrame, pages: DataFrame, uids: DataFrame, down: bool) -> DataFrame:
    """(model, action, iid, position): where one press of an arrow takes the named pages, as one block.

    Pages of several files first gather at the first one. Beyond a file's edge
    the next file takes them; without one they become a file, unless they are a whole file (no row).
    """
    named = ordered_pages(files, pages, uids)
    size = pages.groupBy(*KEYS).agg(F.count("*").alias("n_file"))
    ends = named.groupBy("model").agg(F.min_by("iid", "out_pos").alias("first_iid"), F.max_by("iid", "out_pos").alias("last_iid"), F.min_by("pos", "out_pos").alias("a"), F.max_by("pos", "out_pos").alias("b"), F.count("*").alias("n"))
    w = Window.partitionBy("model").orderBy("pos")
    near = files.withColumn("other", (F.lead if down else F.lag)(F.struct("iid", "pages_loaded")).over(w)).select("model", F.col("iid").alias("first_iid"), F.col("pos").alias("file_pos"), "other")
    others = size.withColumnsRenamed({"iid": "other_iid", "n_file": "n_other"})
    t = ends.join(near, ["model", "first_iid"]).join(size.withColumnRenamed("iid", "first_iid"), ["model", "first_iid"]).withColumn("other_iid", F.col("other.iid")).join(others, ["model", "other_iid"], "left")
    inside = (F.col("b") < F.col("n_file") - 1) if down else (F.col("a") > 0)
    step = F.col("a") + (1 if down else -1)
    over = F.lit(0) if down else F.coalesce("n_other", F.lit(0))

    def plan(action: str, iid: Column, position: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), iid.alias("iid"), position.cast("long").alias("position"))

    none = F.lit(None).cast("string")
    made = (
        F.when(F.col("first_iid") != F.col("last_iid"), plan("move", F.col("first_iid"), F.col("a")))
        .when(inside, plan("move", F.col("first_iid"), step))
        .when(F.col("other.pages_loaded"), plan("move", F.col("other_iid"), over))
        .when(F.col("n") < F.col("n_file"), plan("extract", none, F.col("file_pos") + (1 if down else 0)))
    )
    return t.withColumn("p", made).where("p IS NOT NULL").select("model", "p.*")


def split_selection(pages: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((model, iid) of files that are selected whole, (model, uid) of pages of files selected in part)."""
    tagged = pages.join(uids.select("model", "uid").distinct().withColumn("__s", F.lit(True)), ["model", "uid"], "left")
    whole = tagged.groupBy(*KEYS).agg(F.count_if("__s").alias("s"), F.count("*").alias("n")).where("s > 0")
    part = tagged.where("__s").join(whole.where("s < n").select(*KEYS), list(KEYS), "left_semi").select("model", "uid")
    return whole.where("s = n").select(*KEYS), part


def move_across(files: DataFrame, pages: DataFrame, uids: DataFrame, down: bool, edge: bool = False) -> tuple[DataFrame, DataFrame]:
    """A selection over several files: files selected whole move as files; the selected pages of each other file
    become a file of their own right behind it (before it when moving up), which is their step; with edge they go all the way too."""
    whole, part = split_selection(pages, uids)
    owner = pages.join(part, ["model", "uid"], "left_semi").select("model", "uid", F.col("iid").alias("__from"))
    new_iid = F.concat("__from", F.lit("/part"))
    moved = pages.join(owner, ["model", "uid"], "left").withColumn("iid", F.when(F.col("__from").isNotNull(), new_iid).otherwise(F.col("iid")))
    out = _rank(moved, ["pos"], KEYS).select(*pages.columns)
    parts = owner.select("model", F.col("__from").alias("iid")).distinct()
    rows = files.join(parts, list(KEYS), "left_semi").withColumn("origin_iid", F.coalesce("origin_iid", "iid")).withColumn("iid", F.concat("iid", F.lit("/part")))
    both = files.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1 if down else -1)))
    placed = _drop_empty(_rank(both, ["pos", "__new"]).select(*files.columns), out, F.lit(False))
    units = whole.unionByName(rows.select(*KEYS)) if edge else whole
    return (to_edge(placed, units, down) if edge else step_files(placed, units, down)), out


def drop_position(pages: DataFrame, moved: DataFrame, iid: str, visual_index: int) -> DataFrame:
    """(model, position): a place between pages as seen, less the moved pages before it."""
    before = pages.where((F.col("iid") == iid) & (F.col("pos") < visual_index)).join(moved.select("model", "uid"), ["model", "uid"], "left_semi")
    gone = before.groupBy("model").agg(F.count("*").alias("gone"))
    return pages.select("model").distinct().join(gone, "model", "left").select("model", (F.lit(visual_index) - F.coalesce("gone", F.lit(0))).alias("position"))


def count_redactions(pages: DataFrame) -> DataFrame:
    """(model, n): annotations of the kind redact, for a question before saving."""
    n = F.size(F.filter("annots", lambda a: a["kind"] == "redact"))
    return pages.groupBy("model").agg(F.sum(F.greatest(n, F.lit(0)).cast("long")).alias("n"))


def unique_outputs(jobs: DataFrame) -> DataFrame:
    """jobs (model, stem, suffix, pos) with name: a second of one stem is numbered."""
    w = Window.partitionBy("model", F.lower("stem"), "suffix").orderBy("pos")
    n = F.row_number().over(w) - 1
    return jobs.withColumn("name", F.concat(F.col("stem"), F.when(n > 0, F.concat(F.lit("_"), n)).otherwise(F.lit("")), F.col("suffix")))
