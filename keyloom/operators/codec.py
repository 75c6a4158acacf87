"""The command and parameter token language of drawings: encoding, decoding, cleaning, statistics, text."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids at a base vocabulary of FIRST tokens; a larger base moves all of them up by the difference.
FIRST, COMMAND, COMMANDS_END, NUMBER, PAD, BOS, EOS, ADDED = 151643, 151936, 152218, 173186, 151643, 192398, 192399, 40757
#: Fixed value: what stands for a missing parameter outside of Spark.
MISSING = -2001
#: Number families in the order of their bands, with the bands' widths; the first band starts at 155000.
BANDS_START = 155000
BANDS = (
    "TIME 4100, SPACE 2100, AMPLITUDE 100, ANCHOR 4100, ANIMATED 2, H_FLAG 2, OFFSET_VAL 2, CA 3, JUSTIFY 7, TEXT_TRACKING 601, HAS_STROKE_COLOR 2, "
    "IX 1001, BM 21, CLOSED 2, DIRECTION 6, STAR_TYPE 6, MULTIPLE 6, COMPOSITE 6, SKEW 51, SKEW_AXIS 51, SCALE 3001, ROTATION 1441, EASE 201, SMOOTH 101, "
    "TRACKING 101, INDEX 1001, DDD 2, HD 2, CP 51, HAS_MASK 2, AO 2, TT 6, TP 101, TD 3, CT 2, NUMBER 501, DIM 11, HAS_C_A 2, HAS_C_IX 2, HAS_O_A 2, "
    "HAS_O_IX 2, FILL_RULE 5, TYPE 41, TEXT_RANGE_UNITS 11, INV 2, MODE 11, TEXT_SHAPE_TYPE 11, TEXT_RANDOM 2, COLOR_POINTS 51, ROUND 1101, RADIUS 301, "
    "FREQUENCY 151, SPEED 2001, FONT 2101, COLOR 257, LINE_CAP 5, LINE_JOIN 3, MITER_LIMIT 101, EFFECT 1251, OPACITY 188, WIDTH_VALUE 11098"
)
#: The commands that drawings are written with, and their parameters (name, or name~family) in wire order.
COMMANDS = {
    0: "animation FR~FREQUENCY IP~TIME OP~TIME W~SPACE H~SPACE DDD",
    1: "layer INDEX IN_POINT~TIME OUT_POINT~TIME START_TIME~TIME DDD HD CP HAS_MASK AO TT TP TD CT",
    2: "transform",
    3: "position ANIMATED X~SPACE Y~SPACE Z~SPACE",
    4: "keyframe T~TIME S1~SPACE S2~SPACE S3~SPACE I_X~SPEED I_Y~SPEED O_X~SPEED O_Y~SPEED TO1~SPACE TO2~SPACE TO3~SPACE TI1~SPACE TI2~SPACE TI3~SPACE "
    "I_X2~SPEED I_X3~SPEED I_Y2~SPEED I_Y3~SPEED O_X2~SPEED O_X3~SPEED O_Y2~SPEED O_Y3~SPEED H_FLAG E1~SPACE E2~SPACE E3~SPACE",
    5: "/position",
    6: "scale ANIMATED X~SCALE Y~SCALE Z~SCALE",
    7: "/scale",
    8: "rotation ANIMATED X~ROTATION",
    9: "opacity ANIMATED X~OPACITY",
    10: "/opacity",
    11: "anchor ANIMATED X~ANCHOR Y~ANCHOR Z~ANCHOR",
    12: "group IX CIX~IX BM HD NP~NUMBER",
    13: "/group",
    14: "TransformShape POSITION_X~SPACE POSITION_Y~SPACE SCALE_X~SCALE SCALE_Y~SCALE ROTATION OPACITY ANCHOR_X~ANCHOR ANCHOR_Y~ANCHOR SKEW SKEW_AXIS HD",
    15: "path IX IND~INDEX KS_IX~IX CLOSED HD ANIMATED",
    16: "/path",
    17: "point X~SPACE Y~SPACE IN_X~SPACE IN_Y~SPACE OUT_X~SPACE OUT_Y~SPACE",
    18: "fill R~COLOR G~COLOR B~COLOR COLOR_DIM~DIM HAS_C_A HAS_C_IX C_IX~IX BM FILL_RULE OPACITY COLOR_ANIMATED~ANIMATED OPACITY_ANIMATED~ANIMATED HAS_O_A HAS_O_IX O_IX~IX",
    26: "/transform",
    27: "/layer",
    31: "rect HD D~DIRECTION",
    32: "/rect",
    35: "ellipse",
    36: "/ellipse",
    37: "stroke R~COLOR G~COLOR B~COLOR COLOR_DIM~DIM HAS_C_A HAS_C_IX C_IX~IX BM LC~LINE_CAP LJ~LINE_JOIN ML~MITER_LIMIT WIDTH_ANIMATED~ANIMATED COLOR_ANIMATED~ANIMATED A~COLOR",
    40: "asset FR~FREQUENCY ID_COUNT~COUNT ID_0~TEXT ID_1~TEXT ID_2~TEXT ID_3~TEXT ID_4~TEXT ID_5~TEXT ID_6~TEXT ID_7~TEXT ID_8~TEXT ID_9~TEXT",
    41: "/asset",
    42: "parent PARENT_INDEX~INDEX",
    43: "null_layer INDEX IN_POINT~TIME OUT_POINT~TIME START_TIME~TIME CT HD HAS_MASK AO TT TP TD CP",
    44: "/null_layer",
    45: "precomp_layer INDEX IN_POINT~TIME OUT_POINT~TIME START_TIME~TIME W~SPACE H~SPACE CT HAS_MASK AO TT TP TD DDD HD CP",
    46: "/precomp_layer",
    47: "reference_id ID_COUNT~COUNT ID_0~TEXT ID_1~TEXT ID_2~TEXT ID_3~TEXT ID_4~TEXT ID_5~TEXT ID_6~TEXT ID_7~TEXT ID_8~TEXT ID_9~TEXT",
    48: "dimensions WIDTH~SPACE HEIGHT~SPACE",
    49: "/rotation",
    73: "width VALUE~WIDTH_VALUE",
    89: "text_layer INDEX IN_POINT~TIME OUT_POINT~TIME START_TIME~TIME HAS_MASK",
    90: "/text_layer",
    91: "text_data",
    92: "/text_data",
    94: "solid_layer INDEX IN_POINT~TIME OUT_POINT~TIME START_TIME~TIME WIDTH~SPACE HEIGHT~SPACE HAS_MASK COLOR_R~COLOR COLOR_G~COLOR COLOR_B~COLOR COLOR_A~COLOR",
    95: "/solid_layer",
    129: "/anchor",
    164: "text_keyframes",
    165: "/text_keyframes",
}


def offsets() -> dict[str, int | None]:
    """Each family's first id at the base vocabulary of FIRST tokens; COUNT: of how many text tokens follow, TEXT: those themselves, in no band."""
    names, widths = zip(*[(n, int(w)) for n, w in (b.split() for b in BANDS.split(", "))], strict=True)
    return dict(zip(names, accumulate((BANDS_START, *widths)), strict=False)) | {"COUNT": NUMBER, "TEXT": None}


def dimension(spark: SparkSession, commands: dict[int, str] | None = None) -> DataFrame:
    """(idx, command, params array of (name, start)): a row for each command; start is null for tokens of the base vocabulary."""
    start = offsets()
    rows = []
    for idx, line in (commands or COMMANDS).items():
        name, *params = line.split()
        rows.append((idx, name, [(p.split("~")[0], start[p.split("~")[-1]]) for p in params]))
    return spark.createDataFrame(rows, "idx int, command string, params array<struct<name:string,start:int>>")


def layout(base: int) -> dict[str, int]:
    """Ids of a vocabulary with so many tokens of its own."""
    shift = base - FIRST
    return {"shift": shift, "command": COMMAND + shift, "commands_end": COMMANDS_END + shift, "number": NUMBER + shift, "pad": PAD + shift, "bos": BOS + shift, "eos": EOS + shift, "size": base + ADDED}


def encode(rows: DataFrame, base: int) -> DataFrame:
    """(doc_id, tokens) of rows (doc_id, pos, command, params map<string, double>).

    A command's id, then its parameters that are there, in wire order: rounded half to even, moved to their family's
    band, not clamped. Missing ones are left out, not padded. Unknown commands give nothing.
    """
    shift = base - FIRST
    joined = rows.join(F.broadcast(dimension(rows.sparkSession).withColumnRenamed("params", "order")), "command")  # a row for each command
    there = F.filter("order", lambda p: F.coalesce(F.col("params")[p["name"]], F.lit(MISSING)) != MISSING)
    numbers = F.transform(there, lambda p: F.bround(F.col("params")[p["name"]], 0).cast("bigint") + F.coalesce(p["start"] + shift, F.lit(0)))
    tokens = F.concat(F.array((F.col("idx") + COMMAND + shift).cast("bigint")), numbers)
    line = F.array_sort(F.collect_list(F.struct("pos", tokens.alias("tokens"))))
    return joined.groupBy("doc_id").agg(F.flatten(F.transform(line, lambda x: x["tokens"])).alias("tokens"))


def decode(tokens: DataFrame, base: int) -> DataFrame:
    """(doc_id, at, command, params map<string, double>) of (doc_id, tokens).

    A command's id opens a row; what follows binds to its parameters by position; more than it has, unknown commands and
    what stands before the first command are skipped. Parameters that aren't there aren't in the map.
    """
    shift = base - FIRST
    is_command = (F.col("token") >= COMMAND + shift) & (F.col("token") < COMMANDS_END + shift)
    flat = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("opens", is_command.cast("int"))
    line = Window.partitionBy("doc_id").orderBy("pos")
    placed = flat.withColumn("k", F.sum("opens").over(line)).where("k > 0")
    rows = placed.groupBy("doc_id", "k").agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    rows = rows.withColumn("idx", (F.col("t")[0]["token"] - COMMAND - shift).cast("int")).join(F.broadcast(dimension(tokens.sparkSession)), "idx")
    n = F.least(F.size("params"), F.size("t") - 1)
    bound = F.zip_with(F.slice("params", F.lit(1), n), F.slice("t", F.lit(2), n), lambda p, t: F.struct(p["name"].alias("key"), (t["token"] - F.coalesce(p["start"] + shift, F.lit(0))).cast("double").alias("value")))
    return rows.select("doc_id", "at", "command", F.map_from_entries(bound).alias("params"))


def unshift(token: Column, base: int) -> Column:
    """Ids of commands, numbers and marks back at the base vocabulary of FIRST tokens; text ids stay."""
    return F.when((token >= COMMAND + base - FIRST) & (token < base + ADDED), token - (base - FIRST)).otherwise(token)


def clean(tokens: Column, base: int) -> Column:
    """Without the begin in front, cut at the first end, without padding."""
    ids = layout(base)
    body = F.when(F.get(tokens, F.lit(0)) == ids["bos"], F.slice(tokens, F.lit(2), F.greatest(F.lit(0), F.size(tokens) - 1))).otherwise(tokens)
    end = F.array_position(body, F.lit(ids["eos"]).cast("bigint")).cast("int")
    cut = F.when(end > 0, F.slice(body, F.lit(1), F.greatest(F.lit(0), end - 1))).otherwise(body)
    return F.filter(cut, lambda t: t != ids["pad"])


def wrap(tokens: Column, base: int) -> Column:
    ids = layout(base)
    one = lambda k: F.array(F.lit(ids[k]).cast("bigint"))
    return F.concat(one("bos"), tokens, one("eos"))


def stats(tokens: Column, base: int) -> Column:
    """Whether tokens begin with the begin and hold the end, and how many belong to the language."""
    ids = layout(base)
    valid = F.size(F.filter(tokens, lambda t: (t >= ids["command"]) & (t < ids["size"])))
    return F.struct((F.get(tokens, F.lit(0)) == ids["bos"]).alias("has_bos"), F.array_contains(tokens, F.lit(ids["eos"]).cast("bigint")).alias("has_eos"), valid.alias("n_valid"))


def to_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): rows as lines `(command NAME=value ...)`, whole numbers without a fraction."""
    number = lambda v: F.when(v % 1 == 0, v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    order = F.map_entries("params")
    line = F.concat(F.lit("("), F.array_join(F.concat(F.array("command"), F.transform(order, lambda e: F.concat(e["key"], F.lit("="), number(e["value"])))), " "), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("at", line.alias("line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def from_text(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, command, depth, params) of sequence text; depth: commands around that are open and have an end mark."""
    from ..functions.text import attributes, tag

    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length(tag(F.col("line"))) > 0)
    rows = lines.select("doc_id", "pos", tag(F.col("line")).alias("command"), F.transform_values(attributes(F.col("line")), lambda k, v: v.try_cast("double")).alias("params"))
    paired = [c.split()[0][1:] for c in COMMANDS.values() if c.startswith("/")]
    step = F.when(F.col("command").isin(*paired), 1).when(F.col("command").startswith("/"), -1).otherwise(0)
    line = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(step).over(line), F.lit(0)) - F.when(F.col("command").startswith("/"), 1).otherwise(0)
    return rows.withColumn("depth", depth.cast("int")).select("doc_id", "pos", "command", "depth", "params")
