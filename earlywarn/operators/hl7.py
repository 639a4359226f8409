"""HL7 v2 messages as a table job: tokenise, validate, deduplicate, answer, route, render. Every step is a native expression over (msg_id, seq, raw); only the memory of control ids reads its sorted rows in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.operators.ordered import running
from earlywarn.session import cut
from earlywarn.sources.views import DISPLAY, LOINC, VARIABLES

CR = "\r"
#: Required segments, statuses, and the codes answered with AR; all others are answered with AE.
REQUIRED = {"ADT": ("MSH", "EVN", "PID", "PV1"), "ORU": ("MSH", "PID", "PV1", "OBR", "OBX")}
TYPES = ("ADT^A01", "ADT^A03", "ORU^R01")
REJECTED = ("MSH_MISSING", "ENCODING_CHARACTERS_INVALID", "SEGMENT_ID_INVALID", "FRAME_OVERSIZE", "MESSAGE_TYPE_UNSUPPORTED")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
#: Value types whose text is free, and the time pattern with its ranges.
FREE_TYPES = ("ST", "TX", "FT", "SN", "ID", "IS", "ED", "RP")
DTM_SHAPE = r"^\d{4}((0[1-9]|1[0-2])((0[1-9]|[12]\d|3[01])(([01]\d|2[0-3])([0-5]\d([0-5]\d(\.\d{1,4})?)?)?)?)?)?([+-](0\d|1[0-4])[0-5]\d)?$"
DTM = r"^(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:\.(\d{1,4}))?)?)?)?)?)?([+-]\d{4})?$"


#: Result statuses, and what an id may not hold.
STATUSES = {
    "F": "final", "C": "corrected", "A": "amended", "U": "final", "P": "preliminary", "R": "preliminary", "S": "preliminary", "I": "registered", "O": "registered", "X": "cancelled", "N": "cancelled", "D": "entered-in-error",
    "W": "entered-in-error",
}
NOT_IN_ID = r"[^A-Za-z0-9\-.]"


def piece(text: Column, sep: Column | str, n: int) -> Column:
    """The n-th piece (from 1), empty when there is none."""
    sep = F.lit(sep) if isinstance(sep, str) else sep
    return F.coalesce(F.get(F.split(text, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1), n - 1), F.lit(""))


def piece_count(text: Column, sep: str) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\\Q" + sep + "\\E", -1)))


def subcomponent(field: Column, rep: int, comp: int, sub: int = 1) -> Column:
    return piece(piece(piece(field, "~", rep), "^", comp), "&", sub)


def escape(text: Column) -> Column:
    """Delimiters and line ends as escape sequences, the escape character first."""
    out = F.replace(text, F.lit("\\"), F.lit("\\E\\"))
    for c, e in (("|", "F"), ("^", "S"), ("&", "T"), ("~", "R"), ("\r", "X0D"), ("\n", "X0A")):
        out = F.replace(out, F.lit(c), F.lit(f"\\{e}\\"))
    return out


def unescape(text: Column) -> Column:
    """``text, error``: the bodies between escape characters decoded. A text without them passes through."""
    parts = F.split(text, r"\\", -1)
    known = {"F": "|", "S": "^", "T": "&", "R": "~", "E": "\\", "H": "", "N": ""}

    def body(p: Column) -> Column:
        out = F.when(p.rlike("^X([0-9A-Fa-f]{2})+$"), F.decode(F.unhex(F.substring(p, F.lit(2), F.length(p))), "UTF-8"))
        for k, v in known.items():
            out = out.when(p == k, v)
        return out

    decoded = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(body(p)))
    bad = (F.size(parts) % 2 == 0) | F.exists(decoded, lambda p: p.isNull())
    plain = ~text.contains("\\")
    return F.struct(F.when(plain, text).when(~bad, F.array_join(decoded, "")).alias("text"), F.when(~plain & bad, "ESCAPE_SEQUENCE_INVALID").alias("error"))


def parse_nm(text: Column) -> Column:
    """A number without exponent or blanks; null when it is none."""
    return F.when(text.rlike(NUMBER), text.cast("double"))


def parse_dtm(text: Column) -> Column:
    """``ts, precision, offset, error`` of a DTM; calendar and offset are checked, fractions need full seconds."""
    g = lambda i: F.regexp_extract(text, DTM, i)
    part = lambda i, default: F.coalesce(g(i).try_cast("int"), F.lit(default))
    base = F.try_make_timestamp_ntz(g(1).try_cast("int"), part(2, 1), part(3, 1), part(4, 0), part(5, 0), F.concat(F.when(g(6) == "", "0").otherwise(g(6)), F.when(g(7) != "", F.concat(F.lit("."), g(7))).otherwise("")).try_cast("decimal(16,6)"))
    offset = F.when(g(8) == "", F.lit(None).cast("int")).otherwise(F.when(F.substring(g(8), 1, 1) == "-", -1).otherwise(1) * (F.substring(g(8), 2, 2).try_cast("int") * 60 + F.substring(g(8), 4, 2).try_cast("int")))
    ok = text.rlike(DTM) & base.isNotNull() & F.coalesce(offset.between(-720, 840), F.lit(True)) & ((g(8) == "") | (F.substring(g(8), 4, 2).try_cast("int") < 60))
    precision = F.when(g(7) != "", "fraction").when(g(6) != "", "second").when(g(5) != "", "minute").when(g(4) != "", "hour").when(g(3) != "", "day").when(g(2) != "", "month").otherwise("year")
    return F.struct(F.when(ok, base).alias("ts"), F.when(ok, precision).alias("precision"), F.when(ok, offset).alias("offset"), F.when(~ok, "TIMESTAMP_INVALID").alias("error"))


def dtm_valid(text: Column) -> Column:
    """Whether a DTM is well formed and its day exists: one pattern and one date."""
    offset = F.regexp_extract(text, r"([+-]\d{4})$", 1)
    return text.rlike(DTM_SHAPE) & ((F.length(text) < 8) | F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd").isNotNull() | ~text.rlike(r"^\d{8}")) & ~offset.rlike(r"^(-1[3-4]|-12[0-5][1-9]|-12[1-5]0|\+14[0-5][1-9]|\+14[1-5]0)")


def split_by(text: Column, sep: Column, usual: str) -> Column:
    """Pieces between separators: a constant pattern where the message uses the usual one."""
    return F.when(sep == usual, F.split(text, "\\" + usual, -1)).otherwise(F.split(text, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), F.lit(-1)))


def with_delimiters(msgs: DataFrame) -> DataFrame:
    """Delimiters of each message and the error of its header, if any."""
    raw = F.col("raw")
    enc = piece(raw, F.substring(raw, 4, 1), 2)
    distinct = F.size(F.array_distinct(F.filter(F.split(F.concat(F.substring(raw, 4, 1), enc), ""), lambda c: c != ""))) == F.length(enc) + 1
    fine = F.length(enc).isin(4, 5) & distinct & ~enc.rlike("[A-Za-z0-9\\s]")
    error = F.when(~raw.startswith("MSH"), "MSH_MISSING").when(~fine, "ENCODING_CHARACTERS_INVALID")
    return msgs.withColumns({"field_sep": F.substring(raw, 4, 1), "component_sep": F.substring(enc, 1, 1), "repetition_sep": F.substring(enc, 2, 1), "escape_char": F.substring(enc, 3, 1), "sub_sep": F.substring(enc, 4, 1), "header_error": error})


def lines(raw: Column) -> Column:
    return F.filter(F.split(raw, "\r\n|\r|\n", -1), lambda s: s != "")


def message_segments(msgs: DataFrame) -> DataFrame:
    """``msg_id, segments``: the segments of each message with its ``id`` and ``fields``, in order, for what is asked of a whole message; messages without any are left out. Nothing is exploded, so nothing has to be grouped again."""
    sep = F.col("sep")
    s = msgs.select("msg_id", F.substring("raw", 4, 1).alias("sep"), lines(F.col("raw")).alias("lines")).where(F.size("lines") > 0)
    return s.select("msg_id", F.transform("lines", lambda line: F.struct(F.substring(line, 1, 3).alias("id"), split_by(line, sep, "|").alias("fields"))).alias("segments"))


def segments(msgs: DataFrame) -> DataFrame:
    """One row per segment: ``msg_id, pos, id, occurrence, fields``, split by the separator that the message declares."""
    s = msgs.select("msg_id", F.substring("raw", 4, 1).alias("sep"), F.posexplode(lines(F.col("raw"))).alias("pos", "segment"))
    s = s.withColumn("id", F.substring("segment", 1, 3))
    return s.select("msg_id", (F.col("pos") + 1).alias("pos"), "id", F.row_number().over(Window.partitionBy("msg_id", "id").orderBy("pos")).alias("occurrence"), split_by(F.col("segment"), F.col("sep"), "|").alias("fields"))


def nest(field: Column) -> Column:
    """Repetitions, components, subcomponents of a field; an empty field is an empty array."""
    deep = F.transform(F.split(field, "~", -1), lambda r: F.transform(F.split(r, "\\^", -1), lambda c: F.split(c, "&", -1)))
    return F.when(field == "", F.array().cast("array<array<array<string>>>")).otherwise(deep)


def _at(pieces: Column, n: int) -> Column:
    return F.coalesce(F.get(pieces, n), F.lit(""))


def split_message(msgs: DataFrame) -> DataFrame:
    """Messages with ``fields`` (segments split once, by the declared separator) and the first MSH, PID, EVN, PV1 and OBR of each; MSH-n stands at n - 1."""
    x = with_delimiters(msgs).withColumn("fields", F.transform(lines(F.col("raw")), lambda s: split_by(s, F.col("field_sep"), "|")))
    first = lambda seg: F.get(F.filter("fields", lambda f: f[0] == seg), 0)
    return x.withColumns({seg: first(seg) for seg in ("MSH", "PID", "EVN", "PV1", "OBR")} | {"ids": F.transform("fields", lambda f: f[0])})


def value_type_error(kind: Column, value: Column, rep: Column | str = "~", comp: Column | str = "^") -> Column:
    """``VALUE_TYPE_MISMATCH`` or ``VALUE_NOT_NUMERIC`` where OBX-5 does not fit OBX-2, by repetition; an empty value fits."""
    rep, comp = (F.lit(s) if isinstance(s, str) else s for s in (rep, comp))
    reps = split_by(value, rep, "~")
    comps = lambda r: split_by(r, comp, "^")
    coded = F.forall(reps, lambda r: (_at(comps(r), 0) != "") | (_at(comps(r), 1) != ""))
    timed = F.forall(reps, lambda r: dtm_valid(_at(comps(r), 0)))
    numeric = F.forall(reps, lambda r: r.rlike(NUMBER))
    fits = F.when(kind.isin("CWE", "CE"), coded).when(kind.isin("DTM", "TS"), timed).otherwise(kind.isin(*FREE_TYPES))
    return F.when(value == "", None).when(kind == "NM", F.when(~numeric, "VALUE_NOT_NUMERIC")).when((kind == "") | ~fits, "VALUE_TYPE_MISMATCH")


def validate(msgs: DataFrame) -> DataFrame:
    """``msg_id, seq, control_id, mrn, error_code, stage, digest``: rules in order, the first that fails names the error. Fields are split once; results are looked at in one pass."""
    x = split_message(msgs)
    rep, comp = F.col("repetition_sep"), F.col("component_sep")
    kind, control = F.array_join(split_by(_at(F.col("MSH"), 8), comp, "^"), "^"), _at(F.col("MSH"), 9)
    parts = F.transform(split_by(_at(F.col("PID"), 3), rep, "~"), lambda r: split_by(r, comp, "^"))
    mr = F.get(F.filter(parts, lambda r: _at(r, 4) == "MR"), 0)
    mrn = _at(F.coalesce(mr, F.get(parts, 0)), 0)
    has = lambda names: F.forall(F.array(*(F.lit(n) for n in names)), lambda n: F.array_contains("ids", n))
    time = lambda f: (f == "") | dtm_valid(f)
    times = time(_at(F.col("EVN"), 2)) & time(_at(F.col("PID"), 7)) & time(_at(F.col("PV1"), 44)) & time(_at(F.col("PV1"), 45)) & time(_at(F.col("OBR"), 7))

    def result(f: Column) -> Column:
        code = split_by(_at(f, 3), comp, "^")
        no_code = (_at(code, 0) == "") & (_at(code, 1) == "")
        return F.when(~time(_at(f, 14)), "TIMESTAMP_INVALID").when(~_at(f, 11).rlike("^[CDFINOPRSUWXA]$"), "RESULT_STATUS_INVALID").when(no_code, "OBSERVATION_CODE_MISSING").otherwise(value_type_error(_at(f, 2), _at(f, 5), rep, comp))

    first_fault = F.get(F.array_compact(F.transform(F.filter("fields", lambda f: f[0] == "OBX"), result)), 0)
    error = F.coalesce(
        F.col("header_error"), F.when(F.exists("ids", lambda i: ~i.rlike("^[A-Z][A-Z0-9]{2}$")), "SEGMENT_ID_INVALID"), F.when(~kind.isin(*TYPES), "MESSAGE_TYPE_UNSUPPORTED"), F.when(control == "", "CONTROL_ID_MISSING"),
        F.when(~dtm_valid(_at(F.col("MSH"), 6)), "TIMESTAMP_INVALID"),
        F.when(F.when(kind.startswith("ADT"), ~has(REQUIRED["ADT"])).otherwise(~has(REQUIRED["ORU"])), "SEGMENT_MISSING"), F.when(mrn == "", "MRN_MISSING"),
        F.when(~times, "TIMESTAMP_INVALID"), first_fault,
    )
    y = x.select("msg_id", "seq", control.alias("control_id"), mrn.alias("mrn"), error.alias("error_code"), F.sha2(F.col("raw"), 256).alias("digest"))
    stage = F.when(F.col("error_code").isin("MSH_MISSING", "ENCODING_CHARACTERS_INVALID", "SEGMENT_ID_INVALID"), "parse").when(F.col("error_code").isNotNull(), "validate")
    return y.select("msg_id", "seq", "control_id", "mrn", "error_code", stage.alias("stage"), "digest")


def warnings(msgs: DataFrame) -> DataFrame:
    """``msg_id, codes``: what an accepted message is warned of, each code once, in the order of the rules."""
    raw, x = F.col("raw"), split_message(msgs)
    ranges = F.create_map(*(F.lit(v) for k, (c, _) in LOINC.items() for v in (c, k)))
    low, high = (F.create_map(*(F.lit(v) for k, (c, _) in LOINC.items() for v in (c, float(DISPLAY[k][i])))) for i in (1, 2))
    obx = F.filter("fields", lambda f: f[0] == "OBX")
    code = lambda f: split_by(_at(f, 3), F.col("component_sep"), "^")
    known = lambda f: (_at(code(f), 2) == "LN") & ranges[_at(code(f), 0)].isNotNull()
    number = lambda f: F.when(_at(f, 2) == "NM", parse_nm(_at(f, 5)))
    odd = lambda f: known(f) & F.coalesce((number(f) < low[_at(code(f), 0)]) | (number(f) > high[_at(code(f), 0)]), F.lit(False))
    found = {
        "SEGMENT_TERMINATOR_NOT_CR": raw.contains("\n"), "TRAILING_SEPARATOR": F.exists("fields", lambda f: (F.size(f) > 1) & (F.element_at(f, -1) == "")),
        "NON_ASCII_BYTES": raw.rlike("[^\\x00-\\x7F]") & (_at(F.col("MSH"), 17) == ""), "OBSERVATION_CODE_UNKNOWN": F.exists(obx, lambda f: ~known(f)), "VALUE_IMPLAUSIBLE": F.exists(obx, odd),
    }
    return x.select("msg_id", F.array_compact(F.array(*(F.when(c, k) for k, c in found.items()))).alias("codes"))


def sniff_header(raw: Column) -> Column:
    """``sender, facility, kind, control_id`` of the first line, as far as they can be read, for messages that no rule accepts."""
    line = F.get(F.split(raw, "[\r\n]", 2), 0)
    f = split_by(line, F.coalesce(F.nullif(F.substring(line, 4, 1), F.lit("")), F.lit("|")), "|")
    at = lambda n: F.when(line.startswith("MSH"), F.nullif(_at(f, n), F.lit("")))
    return F.struct(at(2).alias("sender"), at(3).alias("facility"), at(8).alias("kind"), at(9).alias("control_id"))


def cx(field: Column) -> Column:
    """An identifier with its authority and type; valid with an id."""
    p = F.split(field, "\\^", -1)
    return F.struct(_at(p, 0).alias("id"), _at(p, 3).alias("authority"), _at(p, 4).alias("kind"), (_at(p, 0) != "").alias("valid"))


def xpn(field: Column) -> Column:
    """A person's name; valid with a family or a given name."""
    p = F.split(field, "\\^", -1)
    return F.struct(_at(F.split(_at(p, 0), "&", -1), 0).alias("family"), _at(p, 1).alias("given"), _at(p, 2).alias("middle"), ((_at(p, 0) != "") | (_at(p, 1) != "")).alias("valid"))


def cwe(field: Column) -> Column:
    """A coded value; valid with an identifier or a text."""
    p = F.split(field, "\\^", -1)
    return F.struct(_at(p, 0).alias("identifier"), _at(p, 1).alias("text"), _at(p, 2).alias("system"), ((_at(p, 0) != "") | (_at(p, 1) != "")).alias("valid"))


#: Messages whose ids, or whose places, one task sorts.
ROWS_A_TASK = 250_000


def dedupe_control_ids(results: DataFrame, memory: int = 100_000) -> DataFrame:
    """``disposition``: accepted, retransmission (same id and bytes) or rejected (same id, other bytes, CONTROL_ID_DUPLICATE).

    Only accepted messages reserve an id, and only the last ``memory`` of them are remembered: a repeat after that is accepted anew. Messages come in the order of ``seq``, ties by ``msg_id``.

    How many were accepted before a message decides whether its id is still known, and depends on such decisions itself. So counts and decisions take turns: given the counts, each id decides for itself;
    given the decisions, a running sum over ranges counts; ids and ranges are dealt to a task for each ``ROWS_A_TASK`` messages, so no task grows with the table. A message is right once all before it are, so the only stable state is the one of a single reader. Without more ids than the memory holds nothing is forgotten, and one window decides."""
    results, valid = cut(results), F.col("error_code").isNull()  # validation is dear, its rows are slim
    if results.where(valid).select("control_id").distinct().limit(memory + 1).count() <= memory:
        return _remembered_forever(results)
    known = results.where(valid).withColumn("_before", F.lit(0).cast("long"))
    tasks = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // ROWS_A_TASK))
    decided, changed = None, True
    while changed:
        schema = T.StructType([*known.schema.fields, T.StructField("_accepted", T.BooleanType()), T.StructField("_clash", T.BooleanType())])
        dealt = known.repartition(tasks, "control_id").sortWithinPartitions("control_id", "seq", "msg_id")
        decided = cut(dealt.mapInPandas(_forgetful(memory), schema))
        one = F.col("_accepted").cast("long")
        numbered = cut(running(decided, [], [F.col("seq"), F.col("msg_id")], {"_upto": one}, tasks).withColumn("_now", F.col("_upto") - one))
        changed = bool(numbered.where("_now <> _before").limit(1).count())
        known = numbered.withColumn("_before", F.col("_now")).drop("_now", "_upto", "_accepted", "_clash")
    disposition = F.when(F.col("_clash"), "rejected").when(F.col("_accepted"), "accepted").otherwise("retransmission")
    good = decided.withColumn("disposition", disposition).withColumn("error_code", F.when(F.col("_clash"), "CONTROL_ID_DUPLICATE").otherwise(F.col("error_code")))
    bad = results.where(~valid).withColumn("disposition", F.lit("rejected"))
    return good.select(*results.columns, "disposition").unionByName(bad)


def _forgetful(memory: int):
    """The decisions of each id, whose messages come in order, given how many messages were accepted before each. One remembered message is held at a time."""

    def decide(batches):
        name, number, digest = None, None, None
        for x in batches:
            accepted, clash = [], []
            for control, before, bytes_ in zip(x["control_id"], x["_before"], x["digest"], strict=True):
                forgotten = control != name or before - number >= memory
                if forgotten:
                    name, number, digest = control, before + 1, bytes_
                accepted.append(forgotten)
                clash.append(bytes_ != digest)
            yield x.assign(_accepted=accepted, _clash=clash)

    return decide


def _remembered_forever(results: DataFrame) -> DataFrame:
    valid = F.col("error_code").isNull()
    # messages that are not valid reserve nothing, so each is a group of its own
    w = Window.partitionBy(F.when(valid, F.col("control_id")), F.when(~valid, F.col("msg_id"))).orderBy("seq", "msg_id")
    first, n = F.first("digest").over(w), F.row_number().over(w)
    clash = valid & (n > 1) & (first != F.col("digest"))
    x = results.withColumns({"_first": first, "_n": n, "_clash": clash})
    disposition = F.when(~valid | F.col("_clash"), "rejected").when(F.col("_n") > 1, "retransmission").otherwise("accepted")
    return x.withColumn("disposition", disposition).withColumn("error_code", F.when(F.col("_clash"), "CONTROL_ID_DUPLICATE").otherwise(F.col("error_code"))).drop("_first", "_n", "_clash")


def ack_disposition(results: DataFrame) -> DataFrame:
    return results.withColumn("ack_code", F.when(F.col("error_code").isNull(), "AA").when(F.col("error_code").isin(*REJECTED), "AR").otherwise("AE"))


def render(hours: DataFrame, hour_seconds: int) -> DataFrame:
    """One ORU^R01 per stay and hour with results: ``msg_id, seq, raw``. ``hours`` is the dense table with admitted_at."""
    stamp = F.date_format(F.timestamp_add("SECOND", F.col("hour") * hour_seconds, F.col("admitted_at")), "yyyyMMddHHmmss")
    obx = [F.when(F.col(v).isNotNull(), F.concat(F.lit(f"|NM|{LOINC[v][0]}^{v}^LN||"), F.format_string("%.4f", F.col(v)), F.lit(f"|{LOINC[v][1]}|||||F|||"), stamp, F.lit("+0000"))) for v in VARIABLES]
    numbered = F.transform(F.array_compact(F.array(*obx)), lambda s, i: F.concat(F.lit("OBX|"), (i + 1).cast("string"), s))
    user, control = F.col("encounter_id").cast("string"), F.concat(F.lit("M"), F.lpad(F.col("encounter_id").cast("string"), 6, "0"), F.lpad(F.col("hour").cast("string"), 6, "0"))
    head = F.array(
        F.concat(F.lit("MSH|^~\\&|BEDSIDE|"), F.col("site"), F.lit("|EW|HOSP|"), stamp, F.lit("+0000||ORU^R01|"), control, F.lit("|P|2.5.1")),
        F.concat(F.lit("PID|1||MRN"), user, F.lit("^^^HOSP^MR||FAMILY^GIVEN||19600101|F")), F.concat(F.lit("PV1|1|I|ICU^1||||||||||||||||ENC"), user), F.concat(F.lit("OBR|1|||VITALS|||"), stamp, F.lit("+0000")),
    )
    some = hours.where(F.size(F.array_compact(F.array(*(F.col(v) for v in VARIABLES)))) > 0)
    return some.select(F.concat_ws("-", user, F.col("hour").cast("string")).alias("msg_id"), (F.col("encounter_id") * 100000 + F.col("hour")).alias("seq"), "encounter_id", "hour", F.array_join(F.concat(head, numbered), CR).alias("raw"))


def damaged(msgs: DataFrame) -> DataFrame:
    """Every twentieth part of the messages with one of nine faults, by their sequence number."""
    raw, k = F.col("raw"), F.pmod("seq", F.lit(20))
    out = F.when(k == 0, F.substring(raw, 5, 1_000_000)).when(k == 1, F.regexp_replace(raw, "PID\\|[^\r]*\r", "")).when(k == 2, F.replace(raw, F.lit("MSH|^~\\&"), F.lit("MSH|^^\\&")))
    out = out.when(k == 3, F.replace(raw, F.lit(CR), F.lit("\n"))).when(k == 4, F.regexp_replace(raw, "\\|NM\\|([^|]*)\\|\\|([^|]*)\\|", "|NM|$1||abc|")).when(k == 5, F.regexp_replace(raw, "^(MSH\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|)\\d{6}", "$1202413"))
    out = out.when(k == 6, F.replace(raw, F.lit("ORU^R01"), F.lit("ORM^O01"))).when(k == 7, F.replace(raw, F.lit("MRN"), F.lit("")).substr(1, 0)).when(k == 8, F.replace(raw, F.lit("|||||F|||"), F.lit("|||||Q|||")))
    return msgs.withColumn("raw", F.when(k <= 8, out).otherwise(raw))


def first_piece(value: Column, n: int) -> Column:
    """Component ``n`` of the first repetition, by the message's own separators; empty where there is none."""
    first = F.coalesce(F.get(split_by(F.coalesce(value, F.lit("")), F.col("repetition_sep"), "~"), 0), F.lit(""))
    return F.coalesce(F.get(split_by(first, F.col("component_sep"), "^"), n - 1), F.lit(""))


def resource_id(text: Column) -> Column:
    """A resource id: characters that an id can't hold become hyphens; at most 64."""
    return F.substring(F.regexp_replace(text, NOT_IN_ID, "-"), 1, 64)


def results(msgs: DataFrame) -> DataFrame:
    """Every OBX of a message as a row: ``msg_id, control_id, mrn, encounter, number, code, system, kind, raw_value, raw_unit, raw_status, time`` (OBX-14, else OBR-7; empty if neither)."""
    x = split_message(msgs)
    some = lambda seg, n: F.coalesce(F.get(F.col(seg), n), F.lit(""))
    x = x.select("msg_id", "repetition_sep", "component_sep", some("MSH", 9).alias("control_id"), first_piece(some("PID", 3), 1).alias("mrn"), first_piece(some("PV1", 19), 1).alias("encounter"), some("OBR", 7).alias("ordered"), F.explode(F.filter("fields", lambda f: f[0] == "OBX")).alias("f"))
    f = lambda n: F.coalesce(F.get("f", n), F.lit(""))
    return x.select(
        "msg_id", "control_id", "mrn", "encounter", f(1).alias("number"), first_piece(f(3), 1).alias("code"), first_piece(f(3), 3).alias("system"), f(2).alias("kind"), f(5).alias("raw_value"), first_piece(f(6), 1).alias("raw_unit"),
        f(11).alias("raw_status"), F.coalesce(F.nullif(f(14), F.lit("")), "ordered").alias("time"),
    )


def usable() -> Column:
    """Whether a result is converted at all: numeric, with a value, and a code of the table under its system. Others are counted, not errors."""
    return (F.col("system") == "LN") & (F.col("kind") == "NM") & (F.col("raw_value") != "") & F.col("code").isin(*(c for c, _ in LOINC.values()))


def to_observations(msgs: DataFrame) -> DataFrame:
    """FHIR-like observations of result messages: ``msg_id, id, mrn, encounter, code, status, value, unit, effective``. One narrow projection; a missing unit is that of the table."""
    unit = F.create_map(*(F.lit(x) for pair in LOINC.values() for x in pair))[F.col("code")]
    status = F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair))[F.col("raw_status")]
    return results(msgs).where(usable()).select(
        "msg_id", resource_id(F.concat_ws("-", "control_id", "number")).alias("id"), "mrn", "encounter", "code", status.alias("status"), parse_nm(F.col("raw_value")).alias("value"), F.coalesce(F.nullif("raw_unit", F.lit("")), unit).alias("unit"), parse_dtm(F.col("time"))["ts"].alias("effective")
    )


def skipped_results(msgs: DataFrame) -> DataFrame:
    """``msg_id, skipped``: results of each message that are not converted."""
    return results(msgs).groupBy("msg_id").agg(F.sum((~usable()).cast("long")).alias("skipped"))
