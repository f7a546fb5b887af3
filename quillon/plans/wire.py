"""Queries on what goes over the wire: manifests, bodies, images in URLs, sealed splits, sinks, fallbacks and the gate of a dataset."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.binding import bound
from quillon.functions.canonical import canonical, quoted
from quillon.functions.records import is_number, listed, text_at, type_at
from quillon.plans.boxes import BOXES
from quillon.plans.detection import gt
from quillon.plans.records import LINES
from quillon.registry import query, run_sql, table

# Keys that no manifest may carry at any depth, and the fields of its parts.
FORBIDDEN = ("text", "value", "values", "ocr", "html", "dom", "selector", "selectors", "url", "href", "src", "pixels", "rgba", "image", "bytes", "b64", "base64", "plaintext", "secret", "literal", "markup", "innerhtml", "outerhtml")
ROOT_KEYS = ("capability", "capture", "elements", "goal", "manifest_version", "redactions", "request", "verified", "visual_masks")
ELEMENT_KEYS = ("enabled", "id", "name", "offscreen", "role", "source", "visible")
MASK_KEYS = ("bbox", "kind", "method", "reason", "region_id")
_ELEMENT = """'{"id":"#a","role":"button","name":"Go","source":"dom","visible":true,"offscreen":false,"enabled":true}'"""
MANIFESTS = f"""mf as (select o_orderkey id, o_orderkey % 31 d, o_custkey c from orders),
mj as (select id, d, '{{"manifest_version":"' || case d when 1 then '1.1' else '1.2' end || '","goal":"' || case d when 2 then ' ' else 'Pay the bill' end || '","verified":' || case d when 3 then '"yes"' else 'true' end || ',"capture":{{"w":' || case d when 4 then '0' when 5 then '"800"' else '800' end ||
  ',"h":600,"dpr":1.5,"zoom":1,"scale_to_css":0.5,"scroll":{{"x":0,"y":' || case d when 6 then 'null' else '12' end || '}},"origin":"https://h.example","format":"' || case d when 7 then 'png' when 8 then 'webp' else 'none' end || '"}},"capability":{{"backend":"' || case d when 9 then 'cuda' else 'wasm' end || '","tiers_fired":["SENSITIVE"]}},"redactions":' || case d when 10 then '{{}}' else '[]' end ||
  ',"elements":[' || {_ELEMENT} || case d when 11 then ',{{"id":"#b","role":"link"}}' when 12 then ',' || replace({_ELEMENT}, '"source":"dom"', '"source":"ocr"') when 13 then ',' || replace({_ELEMENT}, '"visible":true', '"visible":1') when 14 then ',7' when 15 then ',' || replace({_ELEMENT}, '"id":"#a"', '"id":""') else '' end ||
  '],"visual_masks":[{{"region_id":"' || case d when 16 then 'img:1' else 'canvas:' || cast(c % 4 as string) end || '","kind":"canvas","bbox":[' || cast(c % 90 * 0.5 as string) || ',2,3,' || case d when 17 then '"4"' else '4' end || '],"method":"' || case d when 18 then 'blur' else 'opaque_fill' end || '","reason":"DETECTED"}}],"request":{{"id":"r1","session":"' || case d when 19 then '' else 's1' end || '"}}' ||
  case d when 20 then ',"extra":1' when 21 then ',"html":"<p>"' when 22 then ',"note":{{"deep":[{{"Value":1}}]}}' when 23 then ',"note":"data:image/png"' when 24 then ',"note":"' || repeat('QUJD', 60) || '"' else '' end || '}}' j from mf)"""
_BAD_KEY, _DATA_URL = r""""(?i:{})"\s*:""".format("|".join(FORBIDDEN)), r"""[:\[,]\s*"data:"""
#: A run is looked at from its first character only, so the text is read once; characters one by one are a table in Java's classes, ranges are tests in turn.
_RUN = string.ascii_letters + string.digits + "+/"
_LONG_RUN = f"(?:^|[^{_RUN}])[{_RUN}]{{200}}"


#: What is wrong with the documents of mj (id, j): the path of the first defect, as ap (id, path).
_DEFECTS = f"""e as (select id, unnest(json_extract(j, '$.elements[*]')) e, unnest(range(len(json_extract(j, '$.elements[*]')))) n from mj),
eb as (select id, n, case when json_type(e) <> 'OBJECT' then '' when len(list_filter({list(ELEMENT_KEYS)}, lambda k: not list_contains(json_keys(e), k))) > 0 then '.' || list_filter(['id', 'role', 'name', 'source', 'visible', 'offscreen', 'enabled'], lambda k: not list_contains(json_keys(e), k))[1]
  when json_extract_string(e, '$.id') = '' then '.id' when json_extract_string(e, '$.source') not in ('dom', 'vision', 'dom+vision') then '.source' when json_type(e, '$.visible') <> 'BOOLEAN' then '.visible' end bad from e), ef as (select id, '$.elements[' || min(n) || ']' || arg_min(bad, n) p from eb where bad is not null group by id),
  ap as (select m.id, case when trim(json_extract_string(j, '$.goal')) = '' then '$.goal' when regexp_matches(j, '"(?i:{'|'.join(FORBIDDEN)})"\\s*:') or contains(j, '"data:') or regexp_matches(j, '[A-Za-z0-9+/]{{200}}') then '$' when len(list_filter(json_keys(j), lambda k: k not in {ROOT_KEYS})) > 0 then '$.' || list_filter(json_keys(j), lambda k: k not in {ROOT_KEYS})[1] when json_extract_string(j, '$.manifest_version') <> '1.2' then '$.manifest_version' when json_extract_string(j, '$.capture.format') not in ('webp', 'none') then '$.capture.format'
  when json_extract_string(j, '$.capture.format') = 'webp' and coalesce(json_type(j, '$.capture.q'), 'NULL') not in ('UBIGINT', 'BIGINT', 'DOUBLE') then '$.capture.q' when json_type(j, '$.capture.w') = 'VARCHAR' then '$.capture.w' when json_extract_string(j, '$.capture.w') = '0' then '$.capture' when json_type(j, '$.capture.scroll.y') = 'NULL' then '$.capture.scroll.y' when json_extract_string(j, '$.capability.backend') not in ('wasm', 'webgpu', 'none') then '$.capability.backend' when json_type(j, '$.redactions') <> 'ARRAY' then '$.redactions' when ef.p is not null then ef.p
  when not regexp_matches(coalesce(json_extract_string(j, '$.visual_masks[0].region_id'), 'canvas:0'), '^' || coalesce(json_extract_string(j, '$.visual_masks[0].kind'), 'canvas') || ':[0-9]+$') then '$.visual_masks[0].region_id' when json_extract_string(j, '$.visual_masks[0].method') <> 'opaque_fill' then '$.visual_masks[0].method' when json_type(j, '$.visual_masks[0].bbox[3]') = 'VARCHAR' then '$.visual_masks[0].bbox[3]' when json_type(j, '$.verified') <> 'BOOLEAN' then '$.verified' when json_extract_string(j, '$.request.session') = '' then '$.request.session' else '' end path from mj m left join ef on ef.id = m.id)"""
_CODE = "case path when '' then 'OK' when '$.goal' then 'MISSING_GOAL' when '$' then 'PLAINTEXT_IN_MANIFEST' else 'MALFORMED_MANIFEST' end"


@query("manifest_parse", "F-14 P-11", f"with {MANIFESTS}, {_DEFECTS} select id, {_CODE} code, path from ap")
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a manifest is one, strictly: what it may not carry at any depth, then field by field; a refusal names the path."""
    return judged_manifests(run_sql(spark, sf_dir, f"with {MANIFESTS} select id, j from mj"))


def judged_manifests(d: DataFrame, *carried: str) -> DataFrame:
    """(id, code, path) of documents (id, j), and columns of d that go along."""
    d = d.withColumn("v", F.try_parse_json("j")).withColumn("lists", F.from_json("j", "struct<elements array<string>, visual_masks array<string>>"))
    v, j = F.col("v"), F.col("j")

    def number(path: str) -> Column:
        return F.coalesce(is_number(v, path), F.lit(False))

    def among(path: str, *values: str) -> Column:
        return F.coalesce(text_at(v, path).isin(*values), F.lit(False))

    def each(path: str, keys: tuple[str, ...], order: tuple[str, ...], rules: list) -> Column:
        """Path of the first defect in a list of records: not a record, a field that lacks or is unknown, or a rule (field, test of the record's text)."""
        read = f"struct<{', '.join(f'{k} string' for k in keys)}>"

        def bad(item: Column) -> Column:
            first = lambda names: F.when(F.size(names) > 0, F.concat(F.lit("."), F.get(names, F.lit(0))))
            off = bound(F.json_object_keys(item), lambda own: F.when(own.isNull(), "").otherwise(F.coalesce(first(F.array_except(own, listed(keys))), first(F.array_except(listed(order), own)))))

            def by_field(r: Column) -> Column:
                none = F.lit(None).cast("string")
                return F.coalesce(*[F.when(~F.coalesce(sound(r, item), F.lit(False)), "." + field) for field, sound in rules], none)

            # a record is read once, whatever the number of its rules
            return F.coalesce(off, bound(F.from_json(item, read), by_field))

        found = F.transform(F.col("lists")[path.removeprefix("$.")], lambda item, i: F.concat(F.lit(path + "["), i.cast("string"), F.lit("]"), bad(item)))
        return F.get(F.array_compact(found), F.lit(0))

    def flag(name: str):
        return (name, lambda _, item: item.rlike(rf'"{name}"\s*:\s*(true|false)'))

    elements = each("$.elements", (*ELEMENT_KEYS, "bbox"), ("id", "role", "name", "source", "visible", "offscreen", "enabled"), [
        ("id", lambda e, _: e["id"] != ""), ("role", lambda e, _: e["role"] != ""), ("source", lambda e, _: e["source"].isin("dom", "vision", "dom+vision")), flag("visible"), flag("offscreen"), flag("enabled")])
    masks = each("$.visual_masks", MASK_KEYS, ("region_id", "kind", "bbox", "method", "reason"), [
        ("kind", lambda m, _: m["kind"].isin("canvas", "img")), ("region_id", lambda m, _: m["region_id"].rlike("^(canvas|img):[0-9]+$") & m["region_id"].startswith(m["kind"])), ("method", lambda m, _: m["method"] == "opaque_fill"),
        *[(f"bbox[{k}]", lambda m, _, k=k: m["bbox"].isNotNull() & ~(m["bbox"].contains('"') & m["bbox"].rlike(r'^\[(?:[^,]*,){%d}\s*"' % k))) for k in range(4)]])
    # what several rules read is a column of its own first, and so is the path that the code is read off
    d = d.select(*dict.fromkeys(("id", *carried, "j", "v")), elements.alias("elements"), masks.alias("masks"), F.array_except(F.json_object_keys(j), listed(ROOT_KEYS)).alias("extra"))
    elements, masks, extra = F.col("elements"), F.col("masks"), F.col("extra")
    path = (
        F.when(F.trim(F.coalesce(text_at(v, "$.goal"), F.lit(""))) == "", "$.goal").when(j.rlike(_BAD_KEY) | (j.contains('"data:') & j.rlike(_DATA_URL)) | j.rlike(_LONG_RUN), "$").when(F.size(extra) > 0, F.concat(F.lit("$."), F.get(extra, F.lit(0))))
        .when(~among("$.manifest_version", "1.2"), "$.manifest_version").when(~among("$.capture.format", "webp", "none"), "$.capture.format").when(among("$.capture.format", "webp") & ~number("$.capture.q"), "$.capture.q")
        .when(~number("$.capture.w"), "$.capture.w").when(~number("$.capture.h"), "$.capture.h").when(F.try_variant_get(v, "$.capture.w", "double") <= 0, "$.capture").when(~number("$.capture.scroll.x"), "$.capture.scroll.x").when(~number("$.capture.scroll.y"), "$.capture.scroll.y")
        .when(~among("$.capability.backend", "wasm", "webgpu", "none"), "$.capability.backend").when(~type_at(v, "$.redactions").startswith("ARRAY<"), "$.redactions").when(elements.isNotNull(), elements).when(masks.isNotNull(), masks)
        .when(type_at(v, "$.verified") != "BOOLEAN", "$.verified").when(F.coalesce(text_at(v, "$.request.session"), F.lit("")) == "", "$.request.session").otherwise("")
    )
    at = F.col("path")
    code = F.when(at == "", "OK").when(at == "$.goal", "MISSING_GOAL").when(at == "$", "PLAINTEXT_IN_MANIFEST").otherwise("MALFORMED_MANIFEST")
    return d.select("id", *carried, path.alias("path")).select("id", code.alias("code"), "path", *carried)


# Handoffs from orders, and of their lines the rectangles that the frame's masks cover, in its pixels. Some handoffs were never verified, some
# frames not attested, some orders have no frame; some goals are blank or carry data, and a detector that failed masks a whole region.
_HANDOFFS = """hd as (select o_orderkey id, o_orderkey % 13 <> 0 verified, case o_orderkey % 5 when 0 then 'NONE' when 1 then 'UNATTESTED' else 'ATTESTED' end frame, case o_orderkey % 17 when 0 then ' ' when 1 then 'data:image/png;x' when 2 then 'Say "hi"' else 'Pay the bill' end goal,
  o_orderkey % 7 = 0 fail_closed, case o_orderkey % 3 when 0 then 'TIMEOUT' when 1 then 'SOMETHING' end reason, case o_orderkey % 2 when 0 then 0.5e0 else 0.25e0 end scale from orders where o_orderkey % 5 <> 1 or o_orderkey % 2 = 0),
rc as (select l_orderkey id, case when l_partkey % 4 = 0 then 'img:' else 'canvas:' end || cast(l_linenumber as string) region, l_linenumber n, l_partkey pk, l_suppkey sk, cast(l_partkey % 300 as bigint) x, cast(l_suppkey % 200 as bigint) y, cast(l_quantity as bigint) w, 12 h from lineitem)"""
# Why a mask may be there.
MASK_REASONS = ("DETECTED", "FAIL_CLOSED:UNAVAILABLE", "FAIL_CLOSED:ERROR", "FAIL_CLOSED:TIMEOUT", "FAIL_CLOSED:MALFORMED")
_BOX = "regexp_replace(printf('%.6f', {} * scale), '[.]?0+$', '')"


@query("manifest_build", "P-11", f"""with {_HANDOFFS}, rs as (select *, case when not fail_closed then 'DETECTED' when 'FAIL_CLOSED:' || coalesce(reason, 'ERROR') in {MASK_REASONS} then 'FAIL_CLOSED:' || coalesce(reason, 'ERROR') else 'FAIL_CLOSED:ERROR' end why from hd),
ms as (select rs.id, string_agg('{{"bbox":[' || {_BOX.format('x')} || ',' || {_BOX.format('y')} || ',' || {_BOX.format('w')} || ',' || {_BOX.format('h')} || '],"kind":"' || split_part(region, ':', 1) || '","method":"opaque_fill","reason":"' || why || '","region_id":"' || region || '"}}', ',' order by n, pk, sk, x, y, w) j from rs join rc on rc.id = rs.id where frame = 'ATTESTED' group by rs.id),
mj as (select rs.id, '{{"capability":{{"backend":"wasm","tiers_fired":["T0"]}},"capture":{{"dpr":2,"format":"' || case when frame = 'NONE' then 'none' else 'webp' end || '","h":600,"origin":"https://h.example"' || case when frame = 'NONE' then '' else ',"q":62' end || ',"scale_to_css":0.5,"scroll":{{"x":0,"y":12}},"w":800,"zoom":1}},"elements":[],"goal":"' || regexp_replace(goal, '(["\\\\])', '\\\\\\1', 'g') || '","manifest_version":"1.2","redactions":[],"request":{{"id":"r' || rs.id || '","session":"s"}},"verified":' || (frame = 'NONE')::varchar || ',"visual_masks":[' || coalesce(ms.j, '') || ']}}' j from rs left join ms on ms.id = rs.id),
{_DEFECTS}
select hd.id, case when not verified then 'HANDOFF_NOT_VERIFIED' when frame = 'UNATTESTED' then 'FRAME_NOT_MASK_VERIFIED' else {_CODE} end code, case when verified and frame <> 'UNATTESTED' then path end path, case when verified and frame <> 'UNATTESTED' and path = '' then sha256(mj.j) end manifest_sha256, case when verified and frame <> 'UNATTESTED' and path = '' then strlen(mj.j) end::bigint bytes from hd join mj on mj.id = hd.id join ap on ap.id = hd.id""")  # fmt: skip
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of verified handoffs, with the masks of an attested frame in CSS pixels or without any; each goes through the parser, so that none is built which that refuses."""
    t = {n: run_sql(spark, sf_dir, f"with {_HANDOFFS} select * from {n}") for n in ("hd", "rc")}
    why = F.concat(F.lit("FAIL_CLOSED:"), F.coalesce("reason", F.lit("ERROR")))
    h = t["hd"].withColumn("why", F.when(~F.col("fail_closed"), "DETECTED").when(why.isin(*MASK_REASONS), why).otherwise("FAIL_CLOSED:ERROR"))
    masks = h.where("frame = 'ATTESTED'").select("id", "scale", "why").join(t["rc"], "id")
    mask = F.struct(F.array(*[F.col(c) * F.col("scale") for c in "xywh"]).alias("bbox"), F.split("region", ":")[0].alias("kind"), F.lit("opaque_fill").alias("method"), F.col("why").alias("reason"), F.col("region").alias("region_id"))
    # a mask's text is made per line, before they are gathered
    masks = masks.withColumn("m", mask)
    masks = masks.withColumn("m", canonical(F.col("m"), masks.schema["m"].dataType))
    masks = masks.groupBy(F.col("id").alias("mid")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "pk", "sk", "x", "y", "w", "m")))["m"], ",").alias("masks"))
    framed = F.col("frame") != "NONE"
    capture = F.concat(F.lit('{"dpr":2,"format":"'), F.when(framed, "webp").otherwise("none"), F.lit('","h":600,"origin":"https://h.example"'), F.when(framed, ',"q":62').otherwise(""), F.lit(',"scale_to_css":0.5,"scroll":{"x":0,"y":12},"w":800,"zoom":1}'))
    d = h.join(masks, F.col("id") == F.col("mid"), "left")
    j = F.concat(
        F.lit('{"capability":{"backend":"wasm","tiers_fired":["T0"]},"capture":'), capture, F.lit(',"elements":[],"goal":'), quoted(F.col("goal")), F.lit(',"manifest_version":"1.2","redactions":[],"request":{"id":"r'), F.col("id").cast("string"),
        F.lit('","session":"s"},"verified":'), (~framed).cast("string"), F.lit(',"visual_masks":['), F.coalesce("masks", F.lit("")), F.lit("]}"),
    )
    d = d.select("id", "verified", "frame", j.alias("j"))
    d = judged_manifests(d, "verified", "frame", "j").withColumnRenamed("code", "parsed")
    able = F.col("verified") & (F.col("frame") != "UNATTESTED")
    code = F.when(~F.col("verified"), "HANDOFF_NOT_VERIFIED").when(F.col("frame") == "UNATTESTED", "FRAME_NOT_MASK_VERIFIED").otherwise(F.col("parsed"))
    sent = able & (F.col("path") == "")
    return d.select("id", code.alias("code"), F.when(able, F.col("path")).alias("path"), F.when(sent, F.sha2("j", 256)).alias("manifest_sha256"), F.when(sent, F.octet_length("j").cast("long")).alias("bytes"))


@query("multipart_bodies", "S-10 S-11", """with p as (select c_custkey id, '{"id":' || c_custkey || '}' manifest, c_name || c_phone_ frame from (select *, 'x' || c_nationkey::varchar c_phone_ from customer)), b as (select *, 'b' || substr(sha256(manifest || frame), 1, 32) boundary from p),
w as (select *, '--' || boundary || chr(13) || chr(10) || 'name=manifest' || chr(13) || chr(10) || chr(13) || chr(10) || manifest || chr(13) || chr(10) || '--' || boundary || chr(13) || chr(10) || 'name=frame' || chr(13) || chr(10) || chr(13) || chr(10) || frame || chr(13) || chr(10) || '--' || boundary || '--' || chr(13) || chr(10) body from b)
select id, boundary, sha256(body) body_sha256, strlen(body)::bigint n_bytes, id % 7 <> 0 as sound, case when id % 7 <> 0 then manifest else '' end manifest, case when id % 7 <> 0 then frame else '' end frame from w""")  # fmt: skip
def multipart_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies whose boundary comes from their parts, and the same read back strictly: both parts, nothing before, between or after. Some arrive cut short."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string('{"id":%s}', F.col("c_custkey")).alias("manifest"), F.concat("c_name", F.lit("x"), F.col("c_nationkey").cast("string")).alias("frame"))
    p = p.withColumn("boundary", F.concat(F.lit("b"), F.substring(F.sha2(F.concat("manifest", "frame"), 256), 1, 32)))
    line = F.concat(F.lit("--"), "boundary")
    body = F.concat(line, F.lit("\r\nname=manifest\r\n\r\n"), "manifest", F.lit("\r\n"), line, F.lit("\r\nname=frame\r\n\r\n"), "frame", F.lit("\r\n"), line, F.lit("--\r\n"))
    d = p.withColumn("body", body).withColumn("arrived", F.when(F.col("id") % 7 == 0, F.expr("left(body, length(body) - 4)")).otherwise(F.col("body")))
    pattern = F.concat(F.lit("^--"), "boundary", F.lit("\r\nname=manifest\r\n\r\n([^\r]*)\r\n--"), "boundary", F.lit("\r\nname=frame\r\n\r\n([^\r]*)\r\n--"), "boundary", F.lit("--\r\n$"))
    sound = F.regexp_like("arrived", pattern)
    part = lambda k: F.when(sound, F.expr(f"regexp_extract(arrived, concat('^--', boundary, '\\r\\nname=manifest\\r\\n\\r\\n([^\\r]*)\\r\\n--', boundary, '\\r\\nname=frame\\r\\n\\r\\n([^\\r]*)\\r\\n--', boundary, '--\\r\\n'), {k})")).otherwise("")
    return d.select("id", "boundary", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").cast("long").alias("n_bytes"), sound.alias("sound"), part(1).alias("manifest"), part(2).alias("frame"))


_IMAGES = """im as (select p_partkey id, case p_partkey % 9 when 0 then '89504E470D0A1A0A0000' when 1 then 'FFD8FFE000104A464946' when 2 then '524946460E00000057454250565038200200000000AA' when 3 then '524946461200000057454250455849460200000000AA' when 4 then '524946460A00000057454250565038200200000000AA' when 5 then '474946383961' else '00' end hx, case p_partkey % 5 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/webp' when 3 then 'image/gif' else 'text/plain' end mime from part)"""


@query("image_signatures", "S-05 S-06", f"""with {_IMAGES}, u as (select id, hx, mime, 'data:' || mime || ';base64,' || to_base64(from_hex(hx)) url from im), b as (select *, hex(from_base64(split_part(url, ',', 2))) h from u),
k as (select *, case when starts_with(h, '89504E470D0A1A0A') then 'image/png' when starts_with(h, 'FFD8FF') then 'image/jpeg' when starts_with(h, '474946383961') then 'image/gif' when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'image/webp' else 'unknown' end seen from b)
select id, mime, seen, case when not starts_with(mime, 'image/') then 'NOT_AN_IMAGE' when mime <> seen then 'SIGNATURE_MISMATCH' else 'OK' end verdict,
  case when seen <> 'image/webp' then '-' when ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2))::bigint <> length(h) // 2 - 8 then 'SIZE' when substr(h, 25, 8) not in ('56503820', '5650384C') then 'METADATA' else 'STILL' end container from k""")  # fmt: skip
def image_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in data URLs: whether the bytes are what the URL says, and whether a WebP container has its size and nothing but one still picture."""
    u = run_sql(spark, sf_dir, f"with {_IMAGES} select * from im").withColumn("url", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64(F.unhex("hx"))))
    h = F.hex(F.unbase64(F.substring_index("url", ",", -1)))
    d = u.withColumn("h", h).withColumn("mime", F.regexp_extract("url", "^data:([^;]*);base64,", 1))
    seen = (
        F.when(F.col("h").startswith("89504E470D0A1A0A"), "image/png").when(F.col("h").startswith("FFD8FF"), "image/jpeg").when(F.col("h").startswith("474946383961"), "image/gif")
        .when(F.col("h").startswith("52494646") & (F.substring("h", 17, 8) == "57454250"), "image/webp").otherwise("unknown")
    )
    size = F.conv(F.concat(*[F.substring("h", k, 2) for k in (15, 13, 11, 9)]), 16, 10).cast("long")
    container = F.when(seen != "image/webp", "-").when(size != F.length("h") / 2 - 8, "SIZE").when(~F.substring("h", 25, 8).isin("56503820", "5650384C"), "METADATA").otherwise("STILL")
    return d.select("id", "mime", seen.alias("seen"), F.when(~F.col("mime").startswith("image/"), "NOT_AN_IMAGE").when(F.col("mime") != seen, "SIGNATURE_MISMATCH").otherwise("OK").alias("verdict"), container.alias("container"))


#: Rows of a sealed split that are hashed together: seals of these are hashed once more.
SEALED = 64


@query("sealed_splits", "S-15 S-01 S-03", f"""with r as (select doc_id id, case doc_id % 3 when 0 then 'train' when 1 then 'dev' else 'test' end split, '{{"id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '","n":' || n_chars || '}}' j from documents),
b as (select split, id // {SEALED} k, count(*) n, sha256(string_agg(j, ',' order by id)) h from r group by 1, 2) select split, sum(n)::bigint n, sha256(string_agg(h, ',' order by k)) seal from b group by split""")  # fmt: skip
def sealed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of each split: a tree of two levels over its rows in order of their ids, so that no task holds a split's text."""
    text = F.format_string('{"id":%s,"lang":"%s","n":%s}', F.col("doc_id"), F.coalesce("lang", F.lit("")), F.col("n_chars"))
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("doc_id") % 3 + 1).cast("int"))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), split.alias("split"), text.alias("j"))
    b = r.groupBy("split", F.floor(F.col("id") / SEALED).alias("k")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "j"))).alias("js"))
    b = b.select("split", "k", "n", F.sha2(F.array_join("js.j", ","), 256).alias("h"))
    return b.groupBy("split").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "h"))).alias("hs")).select("split", "n", F.sha2(F.array_join("hs.h", ","), 256).alias("seal"))


_ARRIVALS = f"""{LINES}, ar as (select l_orderkey run, l_linenumber n, case l_shipmode when 'AIR' then 'GET' else 'POST' end method, case when l_quantity > 40 then 'text/html' else 'multipart/form-data' end kind, case when l_tax > 0.07 then 'http://10.0.0.5/x' when l_tax > 0.06 then 'https://localhost/x' else 'http://127.0.0.1:9/x' end url, sha256_body sent, case when l_discount > 0.09 then 'tampered' else sha256_body end arrived, l_quantity * 1000 size_
  from (select *, 'h' || cast(l_partkey as string) sha256_body from li) s)"""


@query("frame_sink", "S-09 S-17 S-18 P-12", f"""with {_ARRIVALS}, k as (select *, case when method <> 'POST' then 'NOT_POST' when kind <> 'multipart/form-data' then 'CONTENT_TYPE' when not regexp_matches(url, '^https?://(127\\.0\\.0\\.1|localhost)([:/]|$)') then 'NOT_LOOPBACK' when size_ > 38000 then 'TOO_LARGE' when arrived <> sent then 'HASH_MISMATCH' end cause from ar)
select run, count(*) arrivals, count(*) filter (cause is null) kept, coalesce(arg_min(cause, n) filter (cause is not null), '-') first_refusal, coalesce(arg_max(arrived, n) filter (cause is null), '-') last_kept from k group by run""")  # fmt: skip
def frame_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink on this machine keeps of the frames that arrive, and its first refusal."""
    a = run_sql(spark, sf_dir, f"with {_ARRIVALS} select * from ar")
    local = F.try_parse_url("url", F.lit("HOST")).isin("127.0.0.1", "localhost") & F.try_parse_url("url", F.lit("PROTOCOL")).isin("http", "https")
    cause = F.when(F.col("method") != "POST", "NOT_POST").when(F.col("kind") != "multipart/form-data", "CONTENT_TYPE").when(~F.coalesce(local, F.lit(False)), "NOT_LOOPBACK").when(F.col("size_") > 38000, "TOO_LARGE").when(F.col("arrived") != F.col("sent"), "HASH_MISMATCH")
    a = a.withColumn("cause", cause)
    g = a.groupBy("run").agg(F.count("*").alias("arrivals"), F.count_if(F.col("cause").isNull()).alias("kept"), F.min(F.when(F.col("cause").isNotNull(), F.struct("n", "cause"))).alias("bad"), F.max(F.when(F.col("cause").isNull(), F.struct("n", "arrived"))).alias("good"))
    return g.select("run", "arrivals", "kept", F.coalesce("bad.cause", F.lit("-")).alias("first_refusal"), F.coalesce("good.arrived", F.lit("-")).alias("last_kept"))


@query("dataset_gate", "D-11 F-18 D-12", f"""with {BOXES}, n as (select sample, count(*) n from gt group by sample), v as (select uid, x >= 0 and y >= 0 and x + w <= 400 and y + h <= 300 inside, uid % 97 <> 0 labelled_inside from gt),
g(chk, bad, of_) as (select 'G1', count(*) filter (w <= 0 or h <= 0), count(*) from gt union all select 'G2', count(*) filter (inside and not labelled_inside), count(*) from v union all select 'G3', count(*) filter (x + w <= 0 or y + h <= 0 or x >= 400 or y >= 300), count(*) from gt union all select 'G4', count(*) filter (n < 2), count(*) from n
  union all select 'G5', (select count(*) from gt a join gt b on a.sample = b.sample and a.cls = b.cls and a.uid < b.uid and a.x = b.x and a.y = b.y and a.w = b.w and a.h = b.h), count(*) from gt union all select 'G6', (select count(*) from (select x, y, w, h from gt group by 1, 2, 3, 4 having count(distinct sample) >= 3 and count(distinct sample) >= 0.02 * (select count(*) from n)) s), count(*) from gt
  union all select 'G7', count(*) - count(distinct uid), count(*) from gt union all select 'G8', (select count(*) from gt where uid not in (select pid from pred)), count(*) from gt union all select 'G9', 0, 0)
select chk, case when of_ = 0 then 'NOT_APPLICABLE' when bad = 0 then 'PASS' else 'FAIL' end verdict, bad::bigint bad, chk in ('G1', 'G3', 'G7') required, (select bool_and(case when chk in ('G1', 'G3', 'G7') then of_ > 0 and bad = 0 else true end) from g) overall from g""")  # fmt: skip
def dataset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine checks of a labelled dataset; what is required must pass and may not be left out, others are reported. No occlusion labels: the ninth does not apply."""
    g = gt(spark, sf_dir)
    other = run_sql(spark, sf_dir, f"with {BOXES} select pid from pred")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= 400) & (F.col("y") + F.col("h") <= 300)
    out = (F.col("x") + F.col("w") <= 0) | (F.col("y") + F.col("h") <= 0) | (F.col("x") >= 400) | (F.col("y") >= 300)
    one = g.agg(F.count("*").alias("n"), F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("G1"), F.count_if(inside & (F.col("uid") % 97 == 0)).alias("G2"), F.count_if(out).alias("G3"), (F.count("*") - F.countDistinct("uid")).alias("G7"))
    samples = g.groupBy("sample").agg(F.count("*").alias("c")).agg(F.count("*").alias("s"), F.count_if(F.col("c") < 2).alias("G4"))
    twins = g.groupBy("sample", "cls", *"xywh").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("long").alias("G5"))
    often = g.groupBy(*"xywh").agg(F.countDistinct("sample").alias("c")).crossJoin(F.broadcast(samples.select("s"))).agg(F.count_if((F.col("c") >= 3) & (F.col("c") >= 0.02 * F.col("s"))).alias("G6"))
    lost = g.join(other, F.col("uid") == F.col("pid"), "left_anti").agg(F.count("*").alias("G8"))
    d = one.crossJoin(samples).crossJoin(twins).crossJoin(often).crossJoin(lost)  # one row each
    rows = [F.struct(F.lit(f"G{k}").alias("chk"), (F.col(f"G{k}") if k < 9 else F.lit(0)).cast("long").alias("bad"), (F.col("s") if k == 4 else F.col("n") if k < 9 else F.lit(0)).cast("long").alias("of_"), F.lit(k in (1, 3, 7)).alias("required")) for k in range(1, 10)]
    overall = (F.col("n") > 0) & (F.col("G1") == 0) & (F.col("G3") == 0) & (F.col("G7") == 0)
    d = d.select(overall.alias("overall"), F.explode(F.array(*rows)).alias("r"))
    return d.select("r.chk", F.when(F.col("r.of_") == 0, "NOT_APPLICABLE").when(F.col("r.bad") == 0, "PASS").otherwise("FAIL").alias("verdict"), "r.bad", "r.required", "overall")


@query("fallbacks", "P-16 F-23", """with o as (select event_id id, user_id, case when event_type = 'error' and value < 12 then 'HOSTILE_REPLY' when event_type = 'error' then 'UNAVAILABLE' when value < 2 then 'TIMEOUT' when value < 4 then 'MALFORMED_PLAN' when value < 5 then 'PLAN_REFUSED' else 'PLANNED' end outcome, row_number() over (partition by user_id order by event_id) turn, count(*) over (partition by user_id) turns from events)
select id, outcome, case when outcome = 'HOSTILE_REPLY' then 'NEVER' when outcome in ('UNAVAILABLE', 'TIMEOUT', 'MALFORMED_PLAN') then case when turn % 5 = 0 then 'BUDGET_SPENT' else 'DETERMINISTIC' end when outcome = 'PLAN_REFUSED' then 'NEVER' else 'NOT_NEEDED' end fallback, case when turns < 1 or turns > 20 then 'TURNS_OUT_OF_RANGE' else 'OK' end budget from o""")  # fmt: skip
def fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another planner may take over after an outcome: never after a hostile or refused plan, and not when the turns are used up."""
    e = table(spark, sf_dir, "events")
    outcome = F.when((F.col("event_type") == "error") & (F.col("value") < 12), "HOSTILE_REPLY").when(F.col("event_type") == "error", "UNAVAILABLE").when(F.col("value") < 2, "TIMEOUT").when(F.col("value") < 4, "MALFORMED_PLAN").when(F.col("value") < 5, "PLAN_REFUSED").otherwise("PLANNED")
    d = e.select(F.col("event_id").alias("id"), outcome.alias("outcome"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("turn"), F.count("*").over(Window.partitionBy("user_id")).alias("turns"))
    after = F.when(F.col("outcome").isin("HOSTILE_REPLY", "PLAN_REFUSED"), "NEVER").when(F.col("outcome") == "PLANNED", "NOT_NEEDED").when(F.col("turn") % 5 == 0, "BUDGET_SPENT").otherwise("DETERMINISTIC")
    return d.select("id", "outcome", after.alias("fallback"), F.when(F.col("turns").between(1, 20), "OK").otherwise("TURNS_OUT_OF_RANGE").alias("budget"))
