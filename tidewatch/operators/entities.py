"""Structured entity parsing (T-01) with the parse fallback order (T-03).

``parse_entities(entities_raw, payload)`` returns STRUCT<entities, raw_iocs, parse_errors>
per row, entirely as column expressions:

* the array is read with ``from_json(.., 'array<string>')`` so each element keeps its raw JSON
  text, and each element is then read as ``map<string,string>`` (keys in document order, nested
  values as JSON text) — the generic handler's "first usable key" depends on that order;
* ``$ref`` image references resolve through a per-row ``$id -> Name`` map;
* file entities emit their nested file hashes as extra entities;
* empty text falls back to the regex IOC extractor over the payload, malformed JSON or a
  non-array to the extractor over the text itself (T-03).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.text import regex_iocs, sanitize_value, valid_hash

# Fixed values (must equal the reference): entity type names.
ENTITY_TYPES = ("account", "host", "ip", "file", "process", "url", "dns", "filehash", "mailbox", "mailmessage",
                "registrykey", "registryvalue", "securitygroup", "cloudapplication", "malware")
RE_IPV4_FULL = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
RE_IPV6_LOOSE = r"^[0-9a-fA-F:]+$"

ENTITY_TYPE = "struct<entity_type:string,primary_value:string,properties:map<string,string>,confidence:double,source_id:string>"
def _empty_props() -> Column:
    return F.create_map().cast("map<string,string>")


def _s(m: Column, key: str) -> Column:
    """Sanitised field (T-04): None when missing or empty after cleaning."""
    return sanitize_value(m[key], key)


def _props(**kv: Column) -> Column:
    items = []
    for k, v in kv.items():
        items += [F.lit(k), v.cast("string")]
    return F.map_filter(F.create_map(*items), lambda k, v: v.isNotNull())


def _ent(etype, primary: Column, props: Column, source_id: Column, confidence: float = 1.0) -> Column:
    return F.struct((etype if isinstance(etype, Column) else F.lit(etype)).alias("entity_type"),
                    primary.alias("primary_value"), props.alias("properties"),
                    F.lit(confidence).alias("confidence"), source_id.alias("source_id"))


def valid_ip(a: Column) -> Column:
    """IPv4 with octets <= 255, or an IPv6-looking value containing ':'."""
    v4 = a.rlike(RE_IPV4_FULL) & F.forall(F.split(a, r"\."), lambda p: p.cast("int") <= 255)
    return F.coalesce(v4 | (a.rlike(RE_IPV6_LOOSE) & F.contains(a, F.lit(":"))), F.lit(False))


def _json_type_name(raw: Column) -> Column:
    t = F.ltrim(raw)
    return (F.when(t.startswith('"'), "str").when(t.startswith("["), "list").when(t.isin("true", "false"), "bool")
            .when(t == "null", "NoneType").when(t.rlike(r"[.eE]"), "float").otherwise("int"))


def _filehash(m: Column) -> tuple[Column, Column]:
    """(entity or null, error or null) for one FileHash object map."""
    algo = F.coalesce(m["Algorithm"], F.lit(""))
    value = _s(m, "Value")
    ok = value.isNotNull() & F.when(algo == "", valid_hash(value)).otherwise(valid_hash(value, algo))
    ent = F.when(ok, _ent("filehash", F.lower(value),
                          F.when(algo != "", F.create_map(F.lit("algorithm"), algo)).otherwise(_empty_props()),
                          m["$id"]))
    err = (F.when(value.isNull(), F.lit("FileHash entity missing Value"))
           .when(~ok, F.concat(F.lit("Invalid hash ("), algo, F.lit("): "), F.substring(value, 1, 20))))
    return ent, err


def _fields(m: Column, names: Column) -> Column:
    """Every sanitised field the handlers use, computed once per entity."""
    ref = F.get_json_object(m["ImageFile"], "$.$ref")
    image = F.when(ref.isNotNull(), sanitize_value(names[ref], "Name")) \
        .otherwise(sanitize_value(F.get_json_object(m["ImageFile"], "$.Name"), "Name"))
    cols = {k: _s(m, k) for k in ("Name", "UPNSuffix", "AadUserId", "Sid", "DnsDomain", "HostName", "NetBiosName",
                                   "Address", "Directory", "CommandLine", "Url", "DomainName", "MailboxPrimaryAddress",
                                   "DisplayName", "Upn", "AzureID", "MdatpDeviceId")}
    return F.struct(F.lower(F.trim(F.coalesce(m["Type"], F.lit("")))).alias("t"), image.alias("image"),
                    *[v.alias(k) for k, v in cols.items()])


def _one(m: Column, f: Column) -> tuple[Column, Column]:
    """Entity struct (or null) and error (or null) for one entity map ``m`` with fields ``f``."""
    t, sid = f["t"], m["$id"]
    name, upn, aad = f["Name"], f["UPNSuffix"], f["AadUserId"]
    acc_primary = F.when(name.isNotNull() & upn.isNotNull(), F.concat(name, F.lit("@"), upn)) \
        .when(aad.isNotNull(), aad).when(name.isNotNull(), name)
    account = _ent("account", acc_primary, _props(name=name, upn_suffix=upn, aad_user_id=aad, sid=f["Sid"],
                                                   is_domain_joined=m["IsDomainJoined"], dns_domain=f["DnsDomain"]), sid)
    hname = F.coalesce(f["HostName"], f["NetBiosName"])
    dnsd = f["DnsDomain"]
    host = _ent("host", F.when(dnsd.isNotNull(), F.concat(hname, F.lit("."), dnsd)).otherwise(hname),
                _props(hostname=hname, dns_domain=dnsd, os_family=m["OSFamily"], os_version=m["OSVersion"],
                       resource_id=f["AzureID"], edr_device_id=f["MdatpDeviceId"]), sid)
    addr = f["Address"]
    ip_ok = addr.isNotNull() & valid_ip(F.coalesce(addr, F.lit("")))
    loc = F.from_json(m["Location"], "map<string,string>")
    ip = _ent("ip", addr, _props(geo_country=loc["CountryCode"], geo_city=loc["City"], asn=loc["Asn"],
                                 carrier=loc["Carrier"]), sid)
    fname = F.coalesce(name, F.lit("unknown"))
    fdir = f["Directory"]
    file_ = _ent("file", fname, _props(directory=fdir, full_path=F.when(fdir.isNotNull(), F.concat(fdir, F.lit("\\"), fname))
                                       .otherwise(fname), size=m["SizeInBytes"]), sid)
    pid = m["ProcessId"]
    process = _ent("process", F.coalesce(f["image"], pid, F.lit("unknown")),
                   _props(process_id=pid, command_line=f["CommandLine"], image_name=f["image"],
                          parent_process_id=m["ParentProcessId"], creation_time=m["CreationTimeUtc"]), sid)
    url = _ent("url", f["Url"], _empty_props(), sid)
    dom = f["DomainName"]
    resolved = m["IpAddresses"]
    dns = _ent("dns", dom, F.when(resolved.isNotNull() & (resolved != "[]"),
                                  F.create_map(F.lit("resolved_ips"), resolved)).otherwise(_empty_props()), sid)
    fh_ent, fh_err = _filehash(m)
    mbx = f["MailboxPrimaryAddress"]
    mailbox = _ent("mailbox", mbx, _props(display_name=f["DisplayName"], upn=f["Upn"]), sid)
    usable = F.filter(F.map_entries(m), lambda e: ~e["key"].startswith("$") & (e["key"] != "Type"))
    first = F.filter(F.transform(usable, lambda e: sanitize_value(e["value"], "")), lambda v: v.isNotNull())
    generic = _ent(t, first.getItem(0), F.map_from_entries(usable), sid)
    is_generic = t.isin(*ENTITY_TYPES[9:])

    ent = (F.when(t == "account", F.when(acc_primary.isNotNull(), account))
           .when(t == "host", F.when(hname.isNotNull(), host))
           .when(t == "ip", F.when(ip_ok, ip))
           .when(t == "file", file_)
           .when(t == "process", process)
           .when(t == "url", F.when(f["Url"].isNotNull(), url))
           .when(t == "dns", F.when(dom.isNotNull(), dns))
           .when(t == "filehash", fh_ent)
           .when(t == "mailbox", F.when(mbx.isNotNull(), mailbox))
           .when(is_generic, F.when(F.size(first) > 0, generic)))
    err = (F.when(~t.isin(*ENTITY_TYPES), F.concat(F.lit("Unknown entity type: "), F.coalesce(m["Type"], F.lit("None"))))
           .when(t == "account", F.when(acc_primary.isNull(), F.lit("Account entity missing Name and AadUserId")))
           .when(t == "host", F.when(hname.isNull(), F.lit("Host entity missing HostName and NetBiosName")))
           .when(t == "ip", F.when(addr.isNull(), F.lit("IP entity missing Address"))
                 .when(~ip_ok, F.concat(F.lit("Invalid IP address: "), addr)))
           .when(t == "url", F.when(f["Url"].isNull(), F.lit("URL entity missing Url")))
           .when(t == "dns", F.when(dom.isNull(), F.lit("DNS entity missing DomainName")))
           .when(t == "filehash", fh_err)
           .when(t == "mailbox", F.when(mbx.isNull(), F.lit("Mailbox entity missing MailboxPrimaryAddress")))
           .when(is_generic, F.when(F.size(first) == 0,
                                    F.concat(F.lit("Generic entity ("), m["Type"], F.lit(") has no usable value")))))
    return ent, err


IOC_TYPES = ("account", "host", "ip", "url", "dns", "filehash", "mailbox")


def parse_entities_df(df: DataFrame, entities_raw: str, payload: str | None = None, out: str = "parsed") -> DataFrame:
    """T-01 + T-03 as staged columns: ``out`` = STRUCT<entities, raw_iocs, parse_errors>.

    Stages are separate projections referenced several times, so the optimizer keeps each
    computed once per row instead of inlining the per-entity expression into every consumer."""
    from tidewatch.operators.text import let
    raw = F.col(entities_raw)
    pay = F.col(payload) if payload is not None else F.lit(None).cast("string")
    elems = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    d = df.withColumn("_maps", F.transform(elems, lambda e: F.struct(e.alias("raw"),
                                                                    F.from_json(e, "map<string,string>").alias("m"))))
    d = d.withColumn("_names", F.map_from_entries(F.transform(
        F.filter("_maps", lambda x: x["m"].isNotNull() & x["m"]["$id"].isNotNull()),
        lambda x: F.struct(x["m"]["$id"], F.coalesce(x["m"]["Name"], F.lit(""))))))

    def per(x):
        def with_fields(f):
            ent, err = _one(x["m"], f)
            own = F.when(x["m"].isNull(), F.struct(F.lit(None).cast(ENTITY_TYPE).alias("e"), F.concat(
                F.lit("Non-dict entity skipped: "), _json_type_name(x["raw"])).alias("err"))) \
                .otherwise(F.struct(ent.alias("e"), err.alias("err")))
            hashes = F.transform(F.coalesce(F.from_json(x["m"]["FileHashes"], "array<map<string,string>>"),
                                            F.array().cast("array<map<string,string>>")),
                                 lambda h: F.struct(_filehash(h)[0].alias("e"), _filehash(h)[1].alias("err")))
            extra = F.when(f["t"] == "file", hashes).otherwise(F.array().cast(f"array<struct<e:{ENTITY_TYPE},err:string>>"))
            return F.concat(F.array(own), extra)
        return let(_fields(x["m"], F.col("_names")), with_fields)

    d = d.withColumn("_items", F.flatten(F.transform("_maps", per)))
    d = d.withColumn("_ents", F.filter(F.transform("_items", lambda i: i["e"]), lambda e: e.isNotNull()))
    d = d.withColumn("_errs", F.filter(F.transform("_items", lambda i: i["err"]), lambda e: e.isNotNull()))
    blank = raw.isNull() | (F.trim(raw) == "")
    valid_json = F.try_parse_json(raw).isNotNull()
    is_array = valid_json & F.ltrim(raw).startswith("[")
    d = d.withColumn("_mode", F.when(blank, F.when(pay.isNotNull(), "payload").otherwise("none"))
                     .when(~valid_json, "bad_json").when(~is_array, "not_array").otherwise("structured"))
    d = d.withColumn("_fb", regex_iocs(F.when(F.col("_mode") == "payload", pay).when(
        F.col("_mode").isin("bad_json", "not_array"), raw)))

    def mk(arr, typ, conf, algo=None):
        return F.transform(arr, lambda v: _ent(typ, v, F.create_map(F.lit("algorithm"), F.lit(algo))
                                               if algo else _empty_props(), F.lit(None).cast("string"), conf))
    fb = F.col("_fb")
    fb_ents = F.concat(mk(fb["ips"], "ip", 0.7), mk(fb["sha256"], "filehash", 0.8, "SHA256"),
                       mk(fb["sha1"], "filehash", 0.7, "SHA1"), mk(fb["domains"], "dns", 0.6))
    mode = F.col("_mode")
    structured_iocs = F.transform(F.filter("_ents", lambda e: e["entity_type"].isin(*IOC_TYPES)),
                                  lambda e: e["primary_value"])
    no_e, no_s = F.array().cast(f"array<{ENTITY_TYPE}>"), F.array().cast("array<string>")
    res = F.struct(
        F.when(mode == "structured", F.col("_ents")).when(mode == "none", no_e).otherwise(fb_ents).alias("entities"),
        F.when(mode == "structured", structured_iocs).when(mode == "none", no_s).otherwise(fb["raw_iocs"]).alias("raw_iocs"),
        F.when(mode == "structured", F.col("_errs"))
         .when(mode == "bad_json", F.array(F.lit("entities_raw JSON error")))
         .when(mode == "not_array", F.array(F.lit("entities_raw is not a JSON array"))).otherwise(no_s)
        .alias("parse_errors"))
    return d.withColumn(out, res).drop("_maps", "_names", "_items", "_ents", "_errs", "_mode", "_fb")
