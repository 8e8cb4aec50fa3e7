"""The plan of a composite: which slides get a geometry of their own, which stills cover what, and the layers of the picture over time.

Times are microseconds, places are pixels of the output unless said otherwise. Caps are by order of time in each media; what lies beyond
them is left out on purpose, as a limit of the render.

Defined results: slides without ink, and slides shorter than their limit, get no geometry; equal starts go by slide; a layer that ends where
it starts shows nowhere; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators.raster import fit_scale

MEDIA = ("media_id",)
SECOND = 1_000_000
#: Overrides, panel stills, popup stills and bridges of a media.
OVERRIDES, PANELS, POPUPS, BRIDGES = 8, 4, 6, 48
#: Steps whose bits share a number.
WORD = 62
#: Slides last seconds, so times meet them in buckets of that order: in hours, each would be compared with hundreds.
BUCKET = 30 * SECOND


@dataclass(frozen=True)
class Stage:
    """Output and source size, the webcam's circle with its margin, and the slides' geometry where nothing is wrong."""

    out_w: int = 1920
    out_h: int = 1080
    width: int = 1620
    height: int = 1080
    cam_x: float = 0.88333 * 1920
    cam_y: float = 0.2032 * 1080
    cam_r: float = 184 + 24
    scale: float = 1.12
    x: int = 53
    y: int = 0
    floor: float = 0.85
    step: float = 0.01
    margins: float = 48

    def under(self, x: Column, y: Column) -> Column:
        """Whether a place lies under the webcam."""
        return (x - self.cam_x) * (x - self.cam_x) + (y - self.cam_y) * (y - self.cam_y) < self.cam_r * self.cam_r


def first_k(df: DataFrame, k: int, keys: Sequence[str] = MEDIA, order: Sequence[str] = ("start_us",)) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def _ink_keys(ink: DataFrame) -> list[str]:
    """What ink meets slides on. The slide comes first: sorts for the join then run on its prefix, not on a few media's."""
    return ["slide", *(k for k in MEDIA if k in ink.columns)]


def overrides(slides: DataFrame, ink: DataFrame, stage: Stage = Stage(), min_len: int = SECOND) -> DataFrame:
    """slides: media_id, slide, start_us, end_us, top, bottom (rows of all that was ever visible, in the source). ink: media_id, slide, y,
    x; without media_id it is that of the slide in every media. Slides that the usual geometry breaks (ink under the webcam, or off at the
    top or bottom) get the largest scale at which their centred content stays clear of the webcam, tried in steps down to the floor: scale,
    x, y, mask_top (white above it).

    At scale s a place of ink lies at the centre plus s times its offset, so its squared distance from the webcam is a parabola in s. Its
    roots bound the steps at which this place collides; only these are rows, never all places times all steps. A slide's steps are or-ed as
    bits, so ink is dealt out once."""
    own = ["slide", *MEDIA, "start_us", "end_us", "top", "bottom", "_s0"]
    s = slides.where(F.col("end_us") - F.col("start_us") >= min_len).select(*MEDIA, "slide", "start_us", "end_us", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))
    s = s.withColumn("_s0", fit_scale(F.col("top"), F.col("bottom"), stage.out_h - stage.margins, stage.scale, 0.0))
    keys = _ink_keys(ink)
    p = ink.select(*keys, F.col("y").cast("double").alias("_y"), F.col("x").cast("double").alias("_x")).join(s, keys)
    off = (stage.y + F.col("bottom") * stage.scale > stage.out_h - 6) | (stage.y + F.col("top") * stage.scale < 2)
    at = lambda k: F.col("_s0") - k * stage.step
    place = lambda scale: ((stage.out_w - stage.width * scale) / 2, (stage.out_h - (F.col("bottom") - F.col("top")) * scale) / 2 - F.col("top") * scale)

    def hits(k: Column) -> Column:
        x, y = place(at(k))
        return stage.under(x + F.col("_x") * at(k), y + F.col("_y") * at(k))

    last = F.floor((F.col("_s0") - stage.floor + 1e-9) / stage.step).cast("int")  # -1 where even the first step is below the floor
    # steps by the roots, one more at both ends for what rounding may shift
    dx, dy = F.col("_x") - stage.width / 2, F.col("_y") - (F.col("top") + F.col("bottom")) / 2
    ox, oy = stage.out_w / 2 - stage.cam_x, stage.out_h / 2 - stage.cam_y
    p = p.withColumns({"_a": dx * dx + dy * dy, "_h": dx * ox + dy * oy}).withColumn("_d", F.col("_h") * F.col("_h") - F.col("_a") * (ox * ox + oy * oy - stage.cam_r**2))
    p = p.withColumns({"_root": F.sqrt(F.greatest(F.lit(0.0), F.col("_d"))), "_last": last})
    lo = F.greatest(F.lit(0), F.floor((F.col("_s0") - (-F.col("_h") + F.col("_root")) / F.col("_a")) / stage.step).cast("int") - 1)
    hi = F.least(F.col("_last"), F.ceil((F.col("_s0") - (-F.col("_h") - F.col("_root")) / F.col("_a")) / stage.step).cast("int") + 1)
    near = (F.col("_a") > 0) & (F.col("_d") >= -1e-3 * F.col("_a") * F.col("_a") - 1)
    p = p.withColumns({"_lo": F.when(near, lo), "_hi": F.when(near, hi)})
    p = p.withColumn("_k", F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi")).otherwise(F.array(F.lit(-1)))))
    # no slide starts above the usual scale, so none has more steps
    steps = max(0, int((stage.scale - stage.floor + 1e-9) / stage.step) + 1)
    words = [range(k, min(k + WORD, steps)) for k in range(0, steps, WORD)]
    hit = F.when((F.col("_k") >= 0) & hits(F.col("_k")), F.col("_k"))
    bit = lambda word: F.when(hit.between(word[0], word[-1]), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k") - word[0])).otherwise(F.lit(0).cast("long"))
    broken = F.bool_or(stage.under(stage.x + F.col("_x") * stage.scale, stage.y + F.col("_y") * stage.scale) | off)
    s = p.groupBy(*own).agg(broken.alias("_b"), *[F.bit_or(bit(word)).alias(f"_m{i}") for i, word in enumerate(words)]).where("_b")
    # the lowest bit that isn't set, word by word
    free = lambda m: F.bit_count(F.bitwise_not(m).bitwiseAND(m + 1) - 1)
    k = F.coalesce(*[F.when(F.col(f"_m{i}") != (1 << len(word)) - 1, free(F.col(f"_m{i}")) + word[0]) for i, word in enumerate(words)], F.lit(steps))
    s = s.withColumn("_k", k).withColumn("scale", F.when(F.col("_k") <= last, at(F.col("_k"))).otherwise(F.lit(stage.floor)))
    x, y = place(F.col("scale"))
    s = s.withColumns({"x": F.bround(x).cast("long"), "y": F.bround(y).cast("long")})
    mask = F.greatest(F.lit(0), F.bround(F.col("y") + F.col("top") * F.col("scale")).cast("long") - 12)
    return s.select(*MEDIA, "slide", "start_us", "end_us", "scale", "x", "y", mask.cast("long").alias("mask_top"))


def recenters(phases: DataFrame, ink: DataFrame, taken: DataFrame, stage: Stage = Stage(), min_len: int = 2_500_000, least: int = 24) -> DataFrame:
    """phases: media_id, slide, start_us, end_us, top, bottom, slide_start_us, slide_end_us. Phases of healthy slides (whose middle no
    override of `taken` holds) that centring moves down by more than `least` and not under the webcam: y, mask_top. Gaps up to
    two seconds are closed."""
    p = phases.where(F.col("slide_end_us") - F.col("slide_start_us") >= min_len).withColumn("t_us", F.floor((F.col("slide_start_us") + F.col("slide_end_us")) / 2).cast("long"))
    p = I.point_join(p, taken.select(*MEDIA, "start_us", "end_us"), bucket_us=BUCKET, how="left_anti")
    y = F.bround((stage.out_h - (F.col("bottom") - F.col("top")) * stage.scale) / 2 - F.col("top") * stage.scale).cast("long")
    p = p.withColumn("y", y).where(F.col("y") > stage.y + least).select(*MEDIA, "slide", "start_us", "end_us", "y", F.greatest(F.lit(0), F.bround(F.col("y") + F.col("top") * stage.scale).cast("long") - 12).cast("long").alias("mask_top"))
    keys = _ink_keys(ink)
    spots = ink.where((stage.x + F.col("x") * stage.scale - stage.cam_x) ** 2 < stage.cam_r**2).select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"))
    own = spots.join(p.select(*keys, "y").distinct(), keys).where(stage.under(stage.x + F.col("_x") * stage.scale, F.col("y") + F.col("_y") * stage.scale)).select(*keys, "y").distinct()
    have = ink.select(*keys).distinct()
    return I.tile(p.join(have, keys, "left_semi").join(own, [*keys, "y"], "left_anti").select(*p.columns))


def patches(panels: DataFrame, popups: DataFrame, slides: DataFrame, taken: DataFrame, ink: DataFrame | None = None, margin: float = 1.06) -> DataFrame:
    """panels, popups: media_id, start_us, end_us when a menu is open. Stills that cover them: of each media the first PANELS and POPUPS, where
    the first slide that holds the middle shows the page without the menu after it or else before it (donor_us), and no override
    holds the middle. ink: media_id, t_us, n (dark pixels in samples): where a page gains ink meanwhile nothing is covered."""
    asked = first_k(panels.select(*MEDIA, "start_us", "end_us", F.lit("panel").alias("kind")), PANELS, order=("start_us", "end_us"))
    asked = asked.unionByName(first_k(popups.select(*MEDIA, "start_us", "end_us", F.lit("popup").alias("kind")), POPUPS, order=("start_us", "end_us")))
    asked = asked.select(*MEDIA, F.floor((F.col("start_us") + F.col("end_us")) / 2).cast("long").alias("t_us"), F.col("start_us").alias("a"), F.col("end_us").alias("b"), "kind")
    asked = I.point_join(asked, taken.select(*MEDIA, "start_us", "end_us"), how="left_anti")
    held = I.point_join(asked, slides.select(*MEDIA, "slide", "start_us", "end_us"))
    held = held.groupBy(*MEDIA, "kind", "a", "b").agg(F.min(F.struct("start_us", "slide", "end_us")).alias("_s"))
    donor = F.when(F.col("b") + 800_000 < F.col("_s.end_us") - 300_000, F.col("b") + 800_000).when(F.col("a") - 800_000 > F.col("_s.start_us") + 300_000, F.col("a") - 800_000)
    out = held.select(*MEDIA, "kind", F.col("_s.slide").alias("slide"), F.col("a").alias("start_us"), F.col("b").alias("end_us"), donor.cast("long").alias("donor_us")).where("donor_us IS NOT NULL")
    if ink is None:
        return out
    base = I.as_of(out.withColumnRenamed("donor_us", "t_us"), ink, MEDIA, "t_us", ["n"]).withColumnRenamed("t_us", "donor_us").withColumnRenamed("n", "_base")
    seen = I.point_join(ink, base.where("_base > 0").select(*MEDIA, "kind", "start_us", "end_us", "_base")).where(F.col("n") > F.col("_base") * margin)
    return base.drop("_base").join(seen.select(*MEDIA, "kind", "start_us", "end_us").distinct(), [*MEDIA, "kind", "start_us", "end_us"], "left_anti").select(*out.columns)


def bridges(slides: DataFrame, most: int = BRIDGES) -> DataFrame:
    """Stills of the slide before over the change to the next, where they are no further apart than 1.2 s: start_us, end_us, donor_us."""
    w = Window.partitionBy(*MEDIA).orderBy("start_us", "slide")
    s = slides.select(*MEDIA, "slide", "start_us", F.lag("start_us").over(w).alias("_a0"), F.lag("end_us").over(w).alias("_a1")).where(F.col("start_us") - F.col("_a1") <= 1_200_000)
    a = F.col("_a1") - 350_000
    b = F.when(F.col("start_us") - F.col("_a1") > 50_000, F.col("start_us")).otherwise(a + 350_000)
    out = s.select(*MEDIA, "slide", a.alias("_a"), b.alias("end_us"), F.greatest(F.col("_a0") + 300_000, F.col("_a1") - 800_000).alias("donor_us")).where(F.col("end_us") - F.col("_a") >= 150_000)
    return first_k(out.withColumnRenamed("_a", "start_us"), most, order=("start_us", "slide"))


def layers(bounds: DataFrame, stage: Stage, zooms: DataFrame, centred: DataFrame, stills: DataFrame, held: DataFrame, shifts: DataFrame) -> DataFrame:
    """Rows for layer_table from the plans: bounds (media_id, lo_us, hi_us), zooms (overrides), centred (recenters), stills (patches), held
    (bridges) and shifts (media_id, start_us, end_us, dx, dy of the webcam). Stills stand where the slide at their donor's time stood."""
    whole = bounds.select(*MEDIA, F.col("lo_us").alias("start_us"), F.col("hi_us").alias("end_us"))
    n = lambda v: F.lit(v).cast("long")

    def rows(df: DataFrame, z: int, layer: str, scale, x, y, mask=None, opaque=False, turn=None) -> DataFrame:
        return df.select(*MEDIA, "start_us", "end_us", F.lit(z).alias("z"), F.lit(layer).alias("layer"), scale.cast("double").alias("scale"), x.cast("long").alias("x"), y.cast("long").alias("y"), (n(0) if mask is None else mask).alias("mask_top"), F.lit(opaque).alias("opaque"), (n(0) if turn is None else turn).alias("turn"))

    one = F.lit(1.0)
    base = rows(whole, 0, "base", F.lit(stage.scale), n(stage.x), n(stage.y), turn=n(2**62)).unionByName(rows(centred, 0, "base", F.lit(stage.scale), n(stage.x), F.col("y"), turn=F.col("start_us")))
    zoom = rows(zooms, 1, "zoom", F.col("scale"), F.col("x"), F.col("y"), F.col("mask_top"), True, -F.col("start_us"))
    margin = rows(centred.where("mask_top > 2"), 2, "margin", one, n(0), n(0), F.col("mask_top"), turn=F.col("start_us"))

    def geometry(df: DataFrame) -> DataFrame:
        """scale, x, y, mask_top of the slide shown at t_us: centred, else zoomed, else as usual; of several the first."""
        keys = [*MEDIA, "start_us", "end_us"]
        p = df.select(*MEDIA, "t_us", F.col("start_us").alias("_a"), F.col("end_us").alias("_b")).distinct()
        first = lambda plan, *cols: I.point_join(p, plan.select(*MEDIA, "start_us", "end_us", *cols)).groupBy(*MEDIA, "_a", "_b").agg(F.min(F.struct("start_us", *cols)).alias("g"))
        c = first(centred, "y", "mask_top").select(*MEDIA, F.col("_a").alias("start_us"), F.col("_b").alias("end_us"), F.col("g").alias("_c"))
        o = first(zooms, "scale", "x", "y", "mask_top").select(*MEDIA, F.col("_a").alias("start_us"), F.col("_b").alias("end_us"), F.col("g").alias("_o"))
        j = df.join(c, keys, "left").join(o, keys, "left")
        zoomed = F.col("_c").isNull() & F.col("_o").isNotNull()
        return j.select(
            *keys, F.when(zoomed, F.col("_o.scale")).otherwise(stage.scale).alias("scale"), F.when(zoomed, F.col("_o.x")).otherwise(n(stage.x)).alias("x"),
            F.when(F.col("_c").isNotNull(), F.col("_c.y")).when(zoomed, F.col("_o.y")).otherwise(n(stage.y)).alias("y"),
            F.when(F.col("_c").isNotNull(), F.col("_c.mask_top")).when(zoomed, F.col("_o.mask_top")).otherwise(n(0)).alias("mask_top"),
        )

    still = geometry(stills.select(*MEDIA, "start_us", "end_us", F.floor((F.col("start_us") + F.col("end_us")) / 2).cast("long").alias("t_us")))
    still = rows(still, 3, "still", F.col("scale"), F.col("x"), F.col("y"), opaque=True, turn=-F.col("start_us"))
    bridge = geometry(held.select(*MEDIA, "start_us", "end_us", F.col("donor_us").alias("t_us")))
    bridge = rows(bridge, 4, "bridge", F.col("scale"), F.col("x"), F.col("y"), F.col("mask_top"), True, -F.col("start_us"))
    cam = rows(whole, 5, "webcam", one, n(0), n(0), turn=n(2**62)).unionByName(rows(shifts, 5, "webcam", one, F.col("dx"), F.col("dy"), turn=F.col("start_us")))
    out = base
    for part in (zoom, margin, still, bridge, cam, rows(whole, 6, "ring", one, n(0), n(0)), rows(whole, 7, "logo", one, n(0), n(0))):
        out = out.unionByName(part)
    return out


def layer_table(layers: DataFrame, bounds: DataFrame, chunk_us: int = 120 * SECOND) -> DataFrame:
    """layers: media_id, start_us, end_us, z, layer, scale, x, y, mask_top, opaque, turn. bounds: media_id, lo_us, hi_us. The stack over
    time: for each elementary interval between two ends of layers one row for each layer that is active in it, from the lowest
    z up (place from 0). Of rows of one layer that are active together the smallest turn counts (then x, y, scale); shown tells whether
    no opaque layer lies above. Intervals of a media neither overlap nor leave gaps within its bounds; a bound without layers has no row.

    Work is dealt out by media and chunk of time. A chunk holds the ends in it, and its last interval reaches to the next chunk's first end,
    so intervals aren't cut at chunks; a layer goes to the chunks it spans. From there on nothing moves: rows of an interval are sorted once."""
    cut = layers.join(bounds, list(MEDIA)).withColumns({"start_us": F.greatest("start_us", "lo_us"), "end_us": F.least("end_us", "hi_us")}).where("start_us < end_us")
    chunk = lambda t: F.floor(F.col(t) / F.lit(chunk_us)).cast("long")
    # bounds come with the layers, not by a union: at 60 times sf0.1 a union left each media's bounds as an interval of their own
    ends = cut.select(*MEDIA, F.explode(F.array("start_us", "end_us", "lo_us", "hi_us")).alias("t_us"))
    cut = cut.drop("lo_us", "hi_us")
    chunks = ends.withColumn("_c", chunk("t_us")).groupBy(*MEDIA, "_c").agg(F.array_sort(F.collect_set("t_us")).alias("_at"))
    after = F.lead(F.col("_at")[0]).over(Window.partitionBy(*MEDIA).orderBy("_c"))
    chunks = chunks.select(*MEDIA, "_c", "_at", F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(after)).alias("_to"))
    spread = cut.withColumn("_c", F.explode(F.sequence(chunk("start_us"), chunk("end_us")))).join(chunks, [*MEDIA, "_c"])
    first = F.when(chunk("start_us") == F.col("_c"), F.array_position("_at", F.col("start_us"))).otherwise(F.lit(1)).cast("int")
    until = F.when(chunk("end_us") == F.col("_c"), F.array_position("_at", F.col("end_us"))).otherwise(F.size("_at") + 1).cast("int")
    what = ["z", "layer", "scale", "x", "y", "mask_top", "opaque", "turn"]
    spread = spread.select(*MEDIA, "_c", *what, F.explode(F.slice(F.arrays_zip("_at", "_to"), first, until - first)).alias("_s"))
    spread = spread.select(*MEDIA, "_c", F.col("_s._at").alias("start_us"), F.col("_s._to").alias("end_us"), *what)
    span = ["start_us", *MEDIA, "_c"]
    best = spread.withColumn("_n", F.row_number().over(Window.partitionBy(*span, "z", "layer").orderBy("turn", "x", "y", "scale", "mask_top", "opaque"))).where("_n = 1")
    own = Window.partitionBy(*span).orderBy("z", "layer")
    top = F.max(F.when(F.col("opaque"), F.col("z"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = best.withColumns({"place": F.row_number().over(own) - 1, "_top": top})
    return best.select(*MEDIA, "start_us", "end_us", "place", "z", "layer", "scale", "x", "y", "mask_top", (F.col("z") >= F.coalesce("_top", F.lit(0))).alias("shown"))
