"""Queries whose records go through the store: manifests with their frames, and frames that are attested before they are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ranking import written
from quillon.registry import query, run_sql, table
from quillon.sources.named_files import registered
from quillon.streaming.runs import shared_dir



def shuffles(spark: SparkSession) -> int:
    """Partitions to deal rows to whose work is much larger than their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Samples of a manifest.
PER_MANIFEST = 40
# Manifests from the parts: a part is a sample with one or two annotations, forty are a manifest. Here and there a manifest breaks a rule,
# and a frame is lost, left over, or not the one that was recorded.
_SAMPLES = f"""s as (select p_partkey k, cast(floor(p_partkey / {PER_MANIFEST}) as bigint) d, cast(p_partkey % {PER_MANIFEST} as bigint) i, p_size z, p_name from part),
t as (select *, d % 7 brk, 'train-' || lpad(cast(i as string), 5, '0') id from s),
u as (select k, d, i, brk, id, 'frames-train/' || id || '.png' path, case when brk = 5 and i = 3 then 'dev' else 'train' end split,
  case when brk = 4 and i = 2 then 'train-00001' when brk = 2 and i = 5 and d % 2 = 0 then 'train-7' else id end own, 'png:' || p_name || ':' || cast(z as string) body,
  '[{{"id":"' || case when brk = 3 and i = 1 then 'train-00000-e9' else id || '-e0' end || '","cls":"button","box":{{"x":' || cast(z as string) || ',"y":2,"w":30.5,"h":10}}}}' || case when z % 2 = 0 then ',{{"id":"' || id || '-e1","cls":"link","box":{{"x":1,"y":2,"w":3,"h":4}}}}' else '' end || ']' notes, z from t)"""
#: The oracle puts the same documents together and reads them as JSON.
_READ = """m as (select d, '{"name":"synthetic","version":"2","split":"' || case when max(brk) = 6 then 'dev' else 'train' end || '","samples":[' || string_agg('{"id":"' || own || '","split":"' || split || '","framePath":"' || path || '","frame":{"w":320,"h":200,"sha256":"' || sha256(body) || '"},"annotations":' || notes || '}', ',' order by i) || ']}' j from u group by d),
e as (select d, json_extract_string(j, '$.split') ms, unnest(json_extract(j, '$.samples[*]')) s, unnest(range(json_array_length(j, '$.samples')::bigint)) pos from m),
x as (select d, ms, pos, s->>'$.id' id, s->>'$.split' sp, s->>'$.framePath' fp, s->>'$.frame.sha256' rec, json_extract_string(s, '$.annotations[*].id') aids from e),
y as (select *, case when sp <> 'train' or not regexp_full_match(id, 'train-[0-9]{5}') then 'FOREIGN_SAMPLE' when row_number() over (partition by d, id order by pos) > 1 then 'DUPLICATE_SAMPLE' when fp <> 'frames-train/' || id || '.png' then 'FOREIGN_FRAME'
  when len(list_distinct(aids)) <> len(aids) or len(list_filter(aids, lambda a: not starts_with(a, id || '-e'))) > 0 then 'FOREIGN_ANNOTATION' end problem from x),
p as (select d, case when any_value(ms) <> 'train' then 'DECLARES_OTHER_SPLIT' else arg_min(problem, pos) filter (problem is not null) end problem from y group by d),
f as (select d, path, sha256(body || case when k % 29 = 0 then '!' else '' end) seen from u where k % 31 <> 0 union all select d, 'frames-train/spare-' || k || '.png', sha256('x') from u where k % 37 = 0)
select 'm' || y.d document, y.id, case when seen is null then 'MISSING' when seen <> rec then 'OTHER_BYTES' else 'PRESENT' end frame, len(aids)::int annotations from y join p using (d) left join f on f.d = y.d and f.path = y.fp where p.problem is null
union all select 'm' || f.d, regexp_extract(path, '/([^/]+)[.]png$', 1), 'UNEXPECTED', null from f join p using (d) where p.problem is null and not exists (select 1 from y where y.d = f.d and y.fp = f.path)
union all select 'm' || d, null, problem, null from p where problem is not null"""


@query("manifest_inventory", "S-01 S-02", f"with {_SAMPLES}, {_READ}")
def manifest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the manifests beside its frame: there, missing, or other bytes than recorded; frames that no sample has; and manifests that are refused, with the rule."""
    registered(spark)
    root = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    parts = shuffles(spark)
    u = run_sql(spark, sf_dir, f"with {_SAMPLES} select * from u").repartition(parts, "d")
    sample = F.format_string('{"id":"%s","split":"%s","framePath":"%s","frame":{"w":320,"h":200,"sha256":"%s"},"annotations":%s}', "own", "split", "path", F.sha2("body", 256), "notes")
    text = F.concat(F.lit('{"name":"synthetic","version":"2","split":"'), F.when(F.max("brk") == 6, "dev").otherwise("train"), F.lit('","samples":['), F.array_join(F.array_sort(F.collect_list(F.struct("i", sample.alias("j"))))["j"], ","), F.lit("]}"))
    # a manifest is a document of PER_MANIFEST samples, so a group is one document
    manifests = u.groupBy("d").agg(text.alias("text")).select(F.concat(F.lit("m"), "d", F.lit("/manifest-train.json")).alias("name"), F.col("text").cast("binary").alias("body"))
    body = F.concat("body", F.when(F.col("k") % 29 == 0, "!").otherwise("")).cast("binary")
    frames = u.where(F.col("k") % 31 != 0).select(F.concat(F.lit("m"), "d", F.lit("/"), "path").alias("name"), body.alias("body"))
    spare = u.where(F.col("k") % 37 == 0).select(F.format_string("m%s/frames-train/spare-%s.png", "d", "k").alias("name"), F.lit(b"x").alias("body"))
    for batch, files in (("manifests", manifests), ("frames", frames.union(spare))):
        files.select("name", F.sha2("body", 256).alias("sha256"), "body").repartition(parts, "name").write.format("named_files").option("path", root).option("batch", batch).mode("append").save()
    # each file and each manifest is read once
    stored = spark.read.format("named_files").option("batch", "frames").load(root)
    at = lambda k: F.regexp_extract("name", "^(m[0-9]+)/(frames-[a-z]+/[^/]+[.]png)$", k)
    found = written(stored.where("name like '%.png'").select(at(1).alias("fd"), at(2).alias("fp"), F.col("sha256").alias("seen")), "frames-found")
    samples = written(spark.read.format("split_manifest").option("split", "train").option("onProblem", "report").load(f"{root}/batch=manifests"), "samples")
    good = samples.where("problem is null")
    both = good.join(found, (F.col("document") == F.col("fd")) & (F.col("frame_path") == F.col("fp")), "left")
    out = both.select("document", "id", F.when(F.col("seen").isNull(), "MISSING").when(F.col("seen") != F.col("frame_sha256"), "OTHER_BYTES").otherwise("PRESENT").alias("frame"), F.size("annotations").alias("annotations"))
    named = good.select(F.col("document").alias("gd"), F.col("frame_path").alias("gp"))
    extra = found.join(good.select(F.col("document").alias("own")).distinct(), F.col("fd") == F.col("own"), "left_semi").join(named, (F.col("fd") == F.col("gd")) & (F.col("fp") == F.col("gp")), "left_anti")
    out = out.union(extra.select("fd", F.regexp_extract("fp", "/([^/]+)[.]png$", 1), F.lit("UNEXPECTED"), F.lit(None).cast("int")))
    return out.union(samples.where("problem is not null").select("document", F.lit(None).cast("string"), "problem", F.lit(None).cast("int")))



# Levels by which a decoded mask may lie above the fill, and pixels by which a mask's interior is inset.
TOLERANCE, INSET = 8, 4
# Frames from the parts, as flat lists of RGB: what was sanitised, black in a mask, and what the encoded file decodes to. The file is a still
# picture's container whose payload is the hash of its pixels. Some decode to another size, some lose their mask inside or at its edge,
# some have no bytes, another container, metadata, or other bytes than were attested, and some are meant to leave the machine.
_FRAMES = """a as (select p_partkey k, cast(p_partkey % 23 as int) b, cast(14 + p_partkey % 3 as int) w, cast(12 as int) h, cast(p_partkey % 4 as int) mx, 1 my, cast(10 + p_partkey % 2 as int) mw, cast(case p_partkey % 6 when 0 then 4 else 10 end as int) mh from part),
g as (select *, {range}(0, w * h * 3) pos from a),
r as (select *, {each}(pos, {i} -> case when {px} between mx and mx + mw - 1 and {py} between my and my + mh - 1 then 0 else cast(({i} * 7 + k * 13) % 256 as int) end) clean from g),
v as (select *, {each}(clean, {c} -> cast(least(255, c + case when {px} between mx + 4 and mx + mw - 5 and {py} between my + 4 and my + mh - 5 and b = 3 then 20 when b = 4 and {px} = mx and {py} = my then 30 else cast(({i} + k) % 9 as int) end) as int)) seen, case when b = 5 then w + 1 else w end dw from r)"""
_SPARK_FRAMES = _FRAMES.format(range="sequence", each="transform", i="i", c="(c, i)", px="floor(i / 3) % w", py="floor(floor(i / 3) / w)").replace("sequence(0, w * h * 3)", "sequence(0, w * h * 3 - 1)")
_DUCK_FRAMES = _FRAMES.format(range="range", each="list_transform", i="i", c="lambda c, j", px="(i // 3) % w", py="((i // 3) // w)").replace("(pos, i ->", "(pos, lambda i:")
_DUCK_FRAMES = _DUCK_FRAMES[: _DUCK_FRAMES.index("v as (")] + _DUCK_FRAMES[_DUCK_FRAMES.index("v as (") :].replace("j ->", "j:").replace("i // 3", "(j - 1) // 3").replace("(i + k)", "(j - 1 + k)")


def _le_duck(x: str) -> str:
    return f"(lpad(lower(to_hex({x} & 255)), 2, '0') || lpad(lower(to_hex(({x} >> 8) & 255)), 2, '0') || lpad(lower(to_hex(({x} >> 16) & 255)), 2, '0') || lpad(lower(to_hex(({x} >> 24) & 255)), 2, '0'))"


_HEXES = "array_to_string(list_transform({}, lambda v: lpad(lower(to_hex(v)), 2, '0')), '')"
_DUCK_FILE = f"'52494646' || {_le_duck('(50 + case when b = 10 then 2 else 0 end)::bigint')} || '57454250' || case when b = 9 then '45584946' else '5650384c' end || {_le_duck('37::bigint')} || '2f' || {_le_duck('((w - 1) + (h - 1) * 16384)::bigint')} || sha256(from_hex({_HEXES.format('seen')})) || '00'"


def _u32(x: str, at: int) -> str:
    return f"('0x' || substr({x}, {at + 6}, 2) || substr({x}, {at + 4}, 2) || substr({x}, {at + 2}, 2) || substr({x}, {at}, 2))::bigint"


@query("attested_frames", "P-12 S-18 S-09", f"""with {_DUCK_FRAMES}, c as (select *, case when b = 1 then '' when b = 2 then '0000' || {_DUCK_FILE} else {_DUCK_FILE} end hx from v),
d as (select *, sha256(from_hex(hx)) webp, sha256(from_hex({_HEXES.format('clean')})) clean_sha, sha256(from_hex({_HEXES.format('seen')})) seen_sha,
  coalesce(list_max(list_transform(list_filter(pos, lambda i: (i // 3) % w between mx + {INSET} and mx + mw - 1 - {INSET} and (i // 3) // w between my + {INSET} and my + mh - 1 - {INSET}), lambda i: seen[i + 1])), -1) inner_,
  list_max(list_transform(list_filter(pos, lambda i: (i // 3) % w between mx and mx + mw - 1 and (i // 3) // w between my and my + mh - 1), lambda i: seen[i + 1])) edge from c),
e as (select *, case when hx = '' then 'ENCODE_EMPTY' when not (starts_with(hx, '52494646') and substr(hx, 17, 8) = '57454250') then 'NOT_WEBP' when dw <> w then 'DIMENSION_MISMATCH' when (case when inner_ >= 0 then inner_ else edge end) > {TOLERANCE} then 'MASK_NOT_PRESERVED' end code from d),
o as (select *, case when code is not null then 'FRAME_NOT_MASK_VERIFIED' when b = 7 then 'DESTINATION_NOT_LOOPBACK' when b = 8 then 'PAYLOAD_HASH_MISMATCH' when substr(hx, 25, 8) <> '5650384c' or {_u32('hx', 9)} <> length(hx) // 2 - 8 or ({_u32('hx', 43)} & 16383) + 1 <> w or (({_u32('hx', 43)} >> 14) & 16383) + 1 <> h then 'NOT_A_STILL_WEBP' end cause from e)
select k id, coalesce(code, 'MASK_VERIFIED') attested, case when code is null then webp end webp_sha256, case when code is null then clean_sha end sanitized_sha256, case when code is null then seen_sha end decoded_sha256,
  case when code is null and inner_ >= 0 then inner_::int end worst_interior, case when code is null then edge::int end worst_edge, coalesce(cause, 'SENT') outcome, case when cause is null then length(hx) // 2 end::bigint peer_bytes, case when cause is null then true end agrees from o""")  # fmt: skip
def attested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are attested (signature, size, mask held; three hashes), judged before they go, and written as files by name; the receipt is what the store holds.

    What an attestation signed is compared with the bytes that go, twice: here, and in the writer's task over the very
    bytes that it writes.
    """
    registered(spark)
    root = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part").select("p_partkey").repartition(shuffles(spark), "p_partkey")
    frames = f"with {_SPARK_FRAMES} select k, b, w, h, mx, my, mw, mh, dw, clean, seen from v"
    spark.sql(frames.replace("from part)", "from {part})"), part=part).write.parquet(f"{root}-pixels")
    v = spark.read.parquet(f"{root}-pixels")
    hexes = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    little = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    v = v.withColumn("clean_sha", F.sha2(F.unhex(hexes("clean")), 256)).withColumn("seen_sha", F.sha2(F.unhex(hexes("seen")), 256))
    file = F.concat(
        F.lit("52494646"), little(F.lit(50) + F.when(F.col("b") == 10, 2).otherwise(0)), F.lit("57454250"), F.when(F.col("b") == 9, "45584946").otherwise("5650384C"), little(F.lit(37)),
        F.lit("2F"), little(F.col("w") - 1 + (F.col("h") - 1) * 16384), F.col("seen_sha"), F.lit("00"),
    )
    v = v.withColumn("bytes", F.unhex(F.when(F.col("b") == 1, "").when(F.col("b") == 2, F.concat(F.lit("0000"), file)).otherwise(file)))

    def worst(inset: int) -> Column:
        """Highest level in the mask less its inset; null if nothing is left of it."""
        x, y = (lambda i: F.floor(i / 3) % F.col("w")), (lambda i: F.floor(F.floor(i / 3) / F.col("w")))
        inside = F.filter("seen", lambda c, i: x(i).between(F.col("mx") + inset, F.col("mx") + F.col("mw") - 1 - inset) & y(i).between(F.col("my") + inset, F.col("my") + F.col("mh") - 1 - inset))
        return F.array_max(inside)

    v = v.withColumn("hx", F.hex("bytes")).withColumn("webp", F.sha2("bytes", 256)).withColumn("inner", worst(INSET)).withColumn("edge", worst(0))
    signed = F.col("hx").startswith("52494646") & (F.substring("hx", 17, 8) == "57454250")
    code = F.when(F.length("bytes") == 0, "ENCODE_EMPTY").when(~signed, "NOT_WEBP").when(F.col("dw") != F.col("w"), "DIMENSION_MISMATCH").when(F.coalesce("inner", "edge") > TOLERANCE, "MASK_NOT_PRESERVED")
    v = v.withColumn("code", code)
    # on its way: where it is to go, and the bytes as they are then
    number = lambda at: F.conv(F.concat(*[F.substring("hx", at + 2 * i, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    sent = v.withColumn("destination", F.when(F.col("b") == 7, "https://sink.example/f").otherwise("http://127.0.0.1:9000/f")).withColumn("now", F.when(F.col("b") == 8, F.concat("bytes", F.lit(b"!"))).otherwise(F.col("bytes")))
    host = F.try_parse_url("destination", F.lit("HOST"))
    still = (F.substring("hx", 25, 8) == "5650384C") & (number(9) == F.length("bytes") - 8) & (number(43).bitwiseAND(16383) + 1 == F.col("w")) & (F.shiftright(number(43), 14).bitwiseAND(16383) + 1 == F.col("h"))
    cause = F.when(F.col("code").isNotNull(), "FRAME_NOT_MASK_VERIFIED").when(~F.coalesce(host.isin("127.0.0.1", "localhost"), F.lit(False)), "DESTINATION_NOT_LOOPBACK").when(F.sha2("now", 256) != F.col("webp"), "PAYLOAD_HASH_MISMATCH").when(~F.coalesce(still, F.lit(False)), "NOT_A_STILL_WEBP")
    judged = written(sent.withColumn("cause", cause).select("k", "code", "cause", "webp", "clean_sha", "seen_sha", "inner", "edge", "now"), "judged")
    kept = judged.where("cause is null").select(F.format_string("f%s.webp", "k").alias("name"), F.col("webp").alias("sha256"), F.col("now").alias("body"))
    kept.write.format("named_files").option("path", root).option("batch", "0").mode("append").save()
    stored = spark.read.format("named_files").option("batch", "0").load(root)
    receipts = stored.select(F.regexp_extract("name", "^f([0-9]+)[.]webp$", 1).cast("long").alias("rk"), F.col("sha256").alias("peer_sha"), F.octet_length("body").cast("long").alias("peer_bytes"))
    out = judged.join(receipts, F.col("k") == F.col("rk"), "left")
    attested = lambda c: F.when(F.col("code").isNull(), F.col(c))
    return out.select(
        F.col("k").alias("id"), F.coalesce("code", F.lit("MASK_VERIFIED")).alias("attested"), attested("webp").alias("webp_sha256"), attested("clean_sha").alias("sanitized_sha256"), attested("seen_sha").alias("decoded_sha256"),
        attested("inner").alias("worst_interior"), attested("edge").alias("worst_edge"), F.coalesce("cause", F.lit("SENT")).alias("outcome"), "peer_bytes", (F.col("peer_sha") == F.col("webp")).alias("agrees"),
    )
