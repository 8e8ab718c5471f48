"""Structured responses: sections of Markdown, their JSON, and the checks that a host makes before it acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contract names, kinds of response, risks in rising order, argument names that an action may list.
ENVELOPE, RESPONSE = "KIE01", "KRESP01"
TYPES, RISKS = ["answer", "command", "report", "question"], ["low", "medium", "high", "critical"]
ARGS = ["mode", "theme", "service_id", "route", "finding_class", "severity", "format", "scope", "target"]
TARGETS = ["export_document", "open_preview", "save_as"]
MODES, THEMES = ["markdown", "html", "pdf", "reveal"], ["plain", "dark", "scientific", "rpg"]
MAX_STEPS = 8
ACTION = "array<struct<name:string,args:map<string,array<string>>>>"
RULE = "array<struct<kind:string,name:string,path:string,contains:string,risk:string>>"


def section_json(markdown: Column, section: str) -> Column:
    """The first fenced json block under `## section`; headings inside fences are text. Null if there is none.

    One fold over the lines keeps where it is: outside, in the section, in its json block, or done.
    """
    head = rf"^## {section}([ \t\r]|$)"

    def line(s: Column, x: Column) -> Column:
        fence = x.startswith("```")
        state = (
            F.when(s["at"] == "done", F.lit("done"))
            .when(s["at"] == "json", F.when(fence, F.lit("done")).otherwise(F.lit("json")))
            .when(s["fenced"], s["at"])
            .when((s["at"] == "in") & x.startswith("```json"), F.lit("json"))
            .when((s["at"] == "in") & x.startswith("##"), F.lit("done"))
            .when((s["at"] == "out") & x.rlike(head), F.lit("in"))
            .otherwise(s["at"])
        )
        fenced = F.when(fence & (state != "json") & (s["at"] != "json"), ~s["fenced"]).when(state == "json", F.lit(False)).otherwise(s["fenced"])
        text = F.when((s["at"] == "json") & (state == "json"), F.concat(s["text"], x, F.lit("\n"))).otherwise(s["text"])
        found = s["found"] | ((s["at"] == "json") & (state == "done"))
        return F.struct(state.alias("at"), fenced.alias("fenced"), text.alias("text"), found.alias("found"))

    start = F.struct(F.lit("out").alias("at"), F.lit(False).alias("fenced"), F.lit("").alias("text"), F.lit(False).alias("found"))
    end = F.aggregate(F.split(markdown, "\n"), start, line)
    return F.when(end["found"], end["text"])


def front_value(markdown: Column, key: str) -> Column:
    """The rest of the line of the first `key:`."""
    got = F.trim(F.regexp_extract(markdown, rf"(?m)^{key}:[ \t]*([^\r\n]*)", 1))
    return F.when(got != "", got)


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk)


def policy_error(rules: Column, result: Column, risk: Column, confirmed: Column) -> Column:
    """What the first broken rule says; null if none is."""
    command, target = (F.get_json_object(result, f"$.machine_result.{c}") for c in ("command", "target"))
    high = (risk_rank(risk) >= 3) & ~confirmed
    at_least = lambda r: F.coalesce(F.nullif(risk_rank(r["risk"]), F.lit(0).cast("long")), F.lit(3).cast("long"))

    def broken(r: Column) -> Column:
        return (
            F.when((r["kind"] == "forbidden_command") & (r["name"] == command), F.lit("response uses a forbidden command"))
            .when((r["kind"] == "forbidden_target") & (r["name"] == target), F.lit("response uses a forbidden target"))
            .when((r["kind"] == "requires_confirmation_if_risk_at_least") & (risk_rank(risk) >= at_least(r)) & ~confirmed, F.lit("policy requires confirmation for this risk level"))
        )

    claim = lambda r: F.when((r["kind"] == "forbidden_claim_contains") & F.coalesce(F.contains(F.call_function("get_json_object", result, F.concat(F.lit("$."), r["path"])), r["contains"]), F.lit(False)), F.lit("response contains a forbidden claim"))
    found = F.filter(F.transform(rules, lambda r: F.coalesce(broken(r), claim(r))), lambda e: e.isNotNull())
    return F.when(high, F.lit("high or critical risk requires confirmation")).otherwise(F.get(found, F.lit(0)))


def action_error(allowed: Column, result: Column) -> Column:
    """What is wrong with a command against the allowed actions; null if nothing is."""
    command, target = (F.get_json_object(result, f"$.machine_result.{c}") for c in ("command", "target"))
    action = F.get(F.filter(allowed, lambda a: a["name"] == command), F.lit(0))
    outside = lambda v, key: v.isNotNull() & F.coalesce(~F.array_contains(action["args"][key], v), F.lit(False))
    args = F.lit(False)
    for key in ARGS:
        args = args | outside(F.get_json_object(result, f"$.machine_result.args.{key}"), key)
    return (
        F.when(F.coalesce(command, F.lit("")) == "", F.lit("machine_result.command is missing"))
        .when(action.isNull(), F.lit("command is not listed in Allowed Actions"))
        .when(outside(target, "target"), F.lit("machine_result.target is not allowed for this command"))
        .when(args, F.lit("machine_result.args contains a value outside the allowed action contract"))
    )


def validated(df: DataFrame, envelope: str = "envelope", response: str = "response") -> DataFrame:
    """df with error (null when accepted), accepted, type, risk, command, and the host's decision; the first failed check counts."""
    result = section_json(F.col(response), "Machine Result")
    df = df.withColumns({"_j": result, "_a": section_json(F.col(envelope), "Allowed Actions"), "_p": section_json(F.col(envelope), "Validation Rules")})
    j = F.col("_j")
    df = df.withColumns({"_ok": F.expr("try_parse_json(_j) IS NOT NULL"), "_allowed": F.from_json("_a", ACTION), "_rules": F.from_json("_p", RULE), **{f"_{c}": F.get_json_object(j, f"$.{c}") for c in ("schema", "type", "human_summary", "risk", "requires_confirmation", "uses_only_provided_context", "machine_result")}})
    confirmed = F.col("_requires_confirmation") == "true"
    flag = lambda c: F.coalesce(F.col(c).isin("true", "false"), F.lit(False))
    checks = [
        (F.coalesce(front_value(F.col(envelope), "schema"), F.lit("")) != ENVELOPE, f"envelope schema is not {ENVELOPE}"),
        (F.coalesce(front_value(F.col(envelope), "response_contract"), F.lit("")) != RESPONSE, f"envelope response contract is not {RESPONSE}"),
        (j.isNull(), "response has no Machine Result JSON block"), (F.col("_a").isNull(), "envelope has no Allowed Actions block"), (F.col("_p").isNull(), "envelope has no Validation Rules block"),
        (~F.col("_ok"), "response Machine Result is not valid JSON"), (F.col("_allowed").isNull(), "Allowed Actions is not valid JSON"), (F.col("_rules").isNull(), "Validation Rules is not valid JSON"),
        (F.coalesce("_schema", F.lit("")) != RESPONSE, f"response schema is not {RESPONSE}"), (~F.coalesce(F.col("_type").isin(TYPES), F.lit(False)), "response type is missing or invalid"),
        (F.coalesce("_human_summary", F.lit("")) == "", "human_summary is missing"), (~F.coalesce(F.col("_risk").isin(RISKS), F.lit(False)), "risk is missing or invalid"),
        (~flag("_requires_confirmation"), "requires_confirmation is missing"), (~flag("_uses_only_provided_context"), "uses_only_provided_context is missing"),
        (F.col("_machine_result").isNull(), "machine_result is missing"), (F.col("_uses_only_provided_context") == "false", "response declares external context usage"),
    ]
    error = F.coalesce(policy_error(F.col("_rules"), j, F.col("_risk"), confirmed), F.when(F.col("_type") == "command", action_error(F.col("_allowed"), j)))
    for on, text in reversed(checks):
        error = F.when(on, F.lit(text)).otherwise(error)
    df = df.withColumn("error", error).withColumns({"accepted": F.col("error").isNull(), "type": F.col("_type"), "risk": F.col("_risk"), "command": F.get_json_object("_j", "$.machine_result.command")})
    decision = F.when(~F.col("accepted"), "reject").when(confirmed, "queue_confirmation").when(F.col("type") == "command", "dispatch_command").otherwise("accept_answer")
    return df.withColumn("decision", decision).select(*[c for c in df.columns if not c.startswith("_") and c not in ("accepted", "type", "risk", "command")], "accepted", "type", "risk", "command", "decision")


def workflow_error(steps: Column) -> Column:
    """What is wrong with an array of steps(command, target, mode, theme); null if nothing is.

    The targets have a fixed order and each needs the one before it, so a valid workflow is a beginning of it.
    """
    n = F.size(steps)
    ok = lambda v, names: F.coalesce(v, F.lit("")).isin(["", *names])
    allowed = F.forall(steps, lambda s: (s["command"] == "emit_ui_command") & s["target"].isin(TARGETS) & ok(s["mode"], MODES) & ok(s["theme"], THEMES))
    targets = F.transform(steps, lambda s: s["target"])
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in TARGETS]), s)

    def one(acc: Column, tg: Column) -> Column:
        e = (
            F.when(F.array_contains(acc["seen"], tg), F.concat(F.lit("duplicate workflow step target: "), tg))
            .when(rank(tg) < acc["last"], F.lit("workflow step order violation"))
            .when((tg != TARGETS[0]) & ~F.array_contains(acc["seen"], F.lit(TARGETS[0])), F.concat(F.lit(f"workflow dependency violation: {TARGETS[0]} required before "), tg))
            .when((tg == TARGETS[2]) & ~F.array_contains(acc["seen"], F.lit(TARGETS[1])), F.lit(f"workflow dependency violation: {TARGETS[1]} required before {TARGETS[2]}"))
        )
        return F.struct(F.array_append(acc["seen"], tg).alias("seen"), rank(tg).alias("last"), F.coalesce(acc["error"], e).alias("error"))

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).cast("long").alias("last"), F.lit(None).cast("string").alias("error"))
    return F.when(steps.isNull(), F.lit("machine_result.workflow array is missing")).when((n == 0) | (n > MAX_STEPS), F.lit("workflow step count outside policy bounds")).when(~allowed, F.lit("workflow step outside sandbox allowlist")).otherwise(F.aggregate(targets, start, one)["error"])


def audit(df: DataFrame, keys: list[str], envelope: str = "envelope", response: str = "response") -> DataFrame:
    """keys and an audit record: digests of both texts with the outcome, as JSON."""
    record = F.to_json(F.struct(F.sha2(envelope, 256).alias("envelope_sha256"), F.sha2(response, 256).alias("response_sha256"), "accepted", "decision", "error"))
    return df.select(*keys, record.alias("audit"))


def envelope_text(domain: Column, task: Column, state: Column, actions: Column, rules: Column) -> Column:
    """The Markdown of a request: front matter, then its sections, JSON ones fenced."""
    fenced = lambda name, x: F.concat(F.lit(f"## {name}\n\n```json\n"), x, F.lit("\n```\n\n"))
    return F.concat(F.lit(f"---\nschema: {ENVELOPE}\nresponse_contract: {RESPONSE}\ndomain: "), domain, F.lit("\n---\n\n## Task\n\n"), task, F.lit("\n\n"), fenced("Current State", state), fenced("Allowed Actions", actions), fenced("Validation Rules", rules))


def document_state(path: Column, text: Column, name: Column | None = None, kind: Column | None = None, app: str = "seqloom") -> Column:
    """A document as state JSON: named by the last part of its path unless a name is given, of type text unless another is."""
    given = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other) if x is not None else other
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    # The state's field names, its adapter and its encoding.
    return F.when(path.isNotNull() & text.isNotNull(), F.to_json(F.struct(
        F.lit(app).alias("app"), F.lit("document").alias("input_adapter"), given(name, base).alias("document_name"), path.alias("document_path"), given(kind, F.lit("text")).alias("document_type"),
        F.lit("utf-8-or-binary-preserved-text").alias("document_encoding"), text.alias("authoritative_document"),
    )))


def synthesized(result: Column) -> Column:
    """A response body that proposes the one known action in another shape, as the command that the contract asks for.

    Null for any other response: nothing else is mended. Scalars may stand in one-element arrays.
    """
    path = lambda p: F.get_json_object(result, f"$.machine_result.{p}")
    scalar = lambda p, other="": F.coalesce(F.nullif(F.coalesce(path(f"{p}[0]"), path(p)), F.lit("")), F.lit(other))
    target = F.when(path("target").isNotNull(), scalar("target")).otherwise(scalar("args.target"))
    action = F.when(path("command").isNotNull(), scalar("command")).otherwise(scalar("action"))
    summary = F.coalesce(F.nullif(F.get_json_object(result, "$.human_summary"), F.lit("")), F.lit("Create a safe sandbox markdown export request."))
    args = F.struct(scalar("args.mode", "markdown").alias("mode"), scalar("args.theme", "plain").alias("theme"))
    body = F.struct(
        F.lit(RESPONSE).alias("schema"), F.lit("command").alias("type"), summary.alias("human_summary"), F.lit("low").alias("risk"), F.lit(False).alias("requires_confirmation"), F.lit(True).alias("uses_only_provided_context"),
        F.struct(F.lit("emit_ui_command").alias("command"), F.lit(TARGETS[0]).alias("target"), args.alias("args")).alias("machine_result"),
    )
    return F.when((action == "emit_ui_command") & (target == TARGETS[0]), F.to_json(body))


def repaired(response: Column) -> Column:
    """Near misses of the contract mended: curly quotes, Python's literals, and commas before a closing bracket."""
    x = F.translate(response, "“”‘’", "\"\"''")
    x = F.regexp_replace(x, r"\bTrue\b", "true")
    x = F.regexp_replace(x, r"\bFalse\b", "false")
    x = F.regexp_replace(x, r"\bNone\b", "null")
    return F.regexp_replace(x, r",(\s*[}\]])", "$1")
