"""Checks of container and infrastructure files: nested blocks as rows of path and value, checks as filters and joins of rows.

Terraform's blocks come from windows over lines: a running count of resource headers gives a line's block, a running sum of
braces its depth, and a block ends where that has reached 0. YAML's come from a small reader of one text in Arrow batches
(indentation; lists by number; scalars; flow lists and maps of scalars). Containers, pods, roles and charts are then groups
of rows, and every check is a condition on a group or a row.

Cases: null and empty texts have no rows and no findings, but for a Dockerfile's missing instructions; a text that is no
mapping has no findings; equal rows count once; an empty table gives no rows; other columns are not read. Not read in
YAML: anchors and aliases, tags, and block scalars' contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.sources.readers import numbered_lines
from quillon.sources.shared import kept
from quillon.sources.tables import dealt, table

# Severity and weakness of every policy.
POLICIES = {
    "CKV_DOCKER_1": ("MEDIUM", "CWE-1104"), "CKV_DOCKER_2": ("LOW", "CWE-693"), "CKV_DOCKER_3": ("HIGH", "CWE-250"), "CKV_DOCKER_4": ("LOW", "CWE-829"), "CKV_DOCKER_5": ("CRITICAL", "CWE-798"), "CKV_DOCKER_6": ("MEDIUM", "CWE-1008"), "CKV_DOCKER_7": ("INFO", "CWE-200"), "CKV_DOCKER_8": ("HIGH", "CWE-250"),
    "CKV_K8S_1": ("CRITICAL", "CWE-250"), "CKV_K8S_2": ("HIGH", "CWE-284"), "CKV_K8S_3": ("HIGH", "CWE-284"), "CKV_K8S_4": ("HIGH", "CWE-284"), "CKV_K8S_5": ("HIGH", "CWE-250"), "CKV_K8S_6": ("MEDIUM", "CWE-770"), "CKV_K8S_7": ("MEDIUM", "CWE-276"), "CKV_K8S_8": ("HIGH", "CWE-798"), "CKV_K8S_9": ("MEDIUM", "CWE-250"), "CKV_K8S_10": ("MEDIUM", "CWE-284"),
    "CKV_TF_1": ("CRITICAL", "CWE-284"), "CKV_TF_2": ("HIGH", "CWE-284"), "CKV_TF_3": ("HIGH", "CWE-311"), "CKV_TF_4": ("CRITICAL", "CWE-798"),
    "CKV_HELM_1": ("HIGH", "CWE-250"), "CKV_HELM_2": ("MEDIUM", "CWE-1104"), "CKV_HELM_3": ("MEDIUM", "CWE-770"),
}
# Settings that are secrets.
SECRETS = (
    r"(?i)(?:password|passwd|pwd)\s*=\s*[^\s\"']+", r"(?i)(?:secret|api_key|apikey|api-key)\s*=\s*[^\s\"']+", r"(?i)(?:token|auth_token|access_token)\s*=\s*[^\s\"']+", r"(?i)(?:aws_access_key_id|aws_secret_access_key)\s*=\s*[^\s\"']+",
    r"(?i)(?:private_key|ssh_key)\s*=\s*[^\s\"']+", r"(?i)bearer\s+[a-zA-Z0-9_\-\.]+", r"AKIA[0-9A-Z]{16}",
)
# Workloads, and Terraform's storage, all of it and what has to say that it is encrypted.
WORKLOADS = ("Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob")
STORAGE, MUST_SAY = ("aws_db_instance", "aws_rds_cluster", "aws_ebs_volume", "aws_s3_bucket", "aws_dynamodb_table"), ("aws_db_instance", "aws_ebs_volume")
_ENTRY = re.compile(r"""^(?:"([^"]*)"|'([^']*)'|([^\s:#'"\[{][^:#]*?|[^\s:#'"\[{])):(?:\s+(.*))?$""")


def _scalar(raw: str) -> tuple[str | None, bool]:
    """A scalar's value (null for none) and whether it is quoted."""
    raw = raw.strip()
    if raw[:1] in "\"'" and raw[:1]:
        end = raw.find(raw[0], 1)
        return raw[1 : end if end > 0 else None], True
    raw = re.sub(r"(?:^|\s)#.*$", "", raw).strip()
    return (None if raw in ("", "~", "null", "Null", "NULL") else raw), False


def _flow(path: str, raw: str, line: int) -> list[tuple[str, str | None, bool, int]]:
    """Rows of a value on one line: a scalar, or a list or map of scalars in brackets."""
    kind = re.match(r"^\[(.*)\]\s*(?:#.*)?$|^\{(.*)\}\s*(?:#.*)?$", raw.strip())
    if not kind:
        return [(path, *_scalar(raw), line)]
    parts = [p for p in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", kind[1] if kind[1] is not None else kind[2]) if p.strip()]
    if kind[1] is not None:
        return [(f"{path}.{i}", *_scalar(p), line) for i, p in enumerate(parts)]
    return [(f"{path}.{k.strip().strip(chr(34) + chr(39))}", *_scalar(v), line) for k, _, v in (p.partition(":") for p in parts)]


def yaml_rows(text: str) -> list[tuple[int, str, str | None, bool, int]]:
    """Document, path, value, whether it is quoted, and line of every leaf of a block text; a key without a value is a leaf of null if nothing is inside it."""
    out: list[tuple[int, str, str | None, bool, int]] = []
    doc, stack, skip = 0, [], None  # the stack: indentation, path, numbers of its items so far, whether anything is inside
    for number, line in enumerate(text.split("\n"), 1):
        body = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if skip is not None and (not body or indent > skip):
            continue  # a block scalar goes on
        skip = None
        if body.startswith("---") or body == "...":
            out += [(doc, p, None, False, n) for _, p, k, inside, n in stack if k == "key" and not inside]
            doc, stack = doc + (body[:3] == "---"), []
            continue
        if not body or body.startswith("#"):
            continue
        while True:
            item = body == "-" or body.startswith("- ")
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (item and stack[-1][2] == "key")):
                if item and stack[-1][2] == "item" and stack[-1][0] == indent:
                    break
                gone = stack.pop()
                if gone[2] == "key" and not gone[3]:
                    out.append((doc, gone[1], None, False, gone[4]))
            if item:
                if stack and stack[-1][2] == "item" and stack[-1][0] == indent:
                    at = int(stack.pop()[1].rpartition(".")[2]) + 1
                else:
                    at = 0
                if stack:
                    stack[-1][3] = True
                path = f"{stack[-1][1]}.{at}" if stack else str(at)
                stack.append([indent, path, "item", False, number])
                rest = body[1:].lstrip(" ")
                if not rest:
                    break
                indent, body = indent + len(body) - len(rest), rest
                if _ENTRY.match(body) or body.startswith("- "):
                    continue
                out += [(doc, *r) for r in _flow(path, body, number)]
                break
            entry = _ENTRY.match(body)
            if not entry:
                break
            if stack:
                stack[-1][3] = True
            name = next(g for g in entry.groups()[:3] if g is not None)
            path = f"{stack[-1][1]}.{name}" if stack else name
            value = (entry[4] or "").strip()
            if not value or value.startswith("#"):
                stack.append([indent, path, "key", False, number])
            elif re.match(r"^[|>][+-]?\d*\s*(?:#.*)?$", value):
                out.append((doc, path, "", True, number))
                skip = indent
            else:
                out += [(doc, *r) for r in _flow(path, value, number)]
            break
    out += [(doc, p, None, False, n) for _, p, k, inside, n in stack if k == "key" and not inside]
    return out


def yaml_paths(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, doc (from 0), at (dotted path, list items by number), value, quoted and line of every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in yaml_rows(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32()))], names=["key", "doc", "at", "value", "quoted", "line"])

    return df.select(key, text).distinct().mapInArrow(run, f"key {dict(df.dtypes)[key]}, doc int, at string, value string, quoted boolean, line int").withColumnRenamed("key", key)


def truthy() -> Column:
    """Whether a row's value counts as set."""
    return F.col("value").isNotNull() & F.when(F.col("quoted"), F.col("value") != "").otherwise(~F.lower("value").isin("false", "no", "off", "0", "[]", "{}"))


def _secret(setting: Column) -> Column:
    return setting.rlike("|".join(f"(?:{p})" for p in SECRETS))


def _judged(df: DataFrame, key: str) -> DataFrame:
    """key, policy, severity, cwe_id, resource and line_number."""
    of = lambda i: F.create_map(*(F.lit(x) for k, v in POLICIES.items() for x in (k, v[i])))[F.col("policy")]
    return df.select(key, "policy", of(0).alias("severity"), of(1).alias("cwe_id"), "resource", F.col("line_number").cast("int").alias("line_number"))


def _each(checks: dict[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in checks.items()))))


def kubernetes_findings(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Findings of Kubernetes manifests; a file holds any number of documents.

    Texts are read once. Documents, pods and containers grow with the files, so their joins are merges: the size of a file
    says little about the rows made of it, and a join planned by it would send them all through the driver.
    """
    rows = kept(yaml_paths(df, key, text), "yaml")
    doc = [key, "doc"]
    value_at = lambda p: F.max(F.when(F.col("at") == p, F.col("value")))
    heads = rows.groupBy(*doc).agg(value_at("kind").alias("kind"), value_at("metadata.name").alias("name"), F.bool_or(F.col("at").rlike(r"^spec\.template(\.|$)")).alias("templated"), F.bool_or((F.col("at") == "automountServiceAccountToken") & ~truthy()).alias("unmounted"))
    heads = heads.withColumn("name", F.coalesce("name", F.concat(F.lit("doc-"), F.col("doc").cast("string"))))
    inner = F.when(F.col("templated") & F.col("at").startswith("spec.template.spec."), F.expr("substring(at, 20)")).when(~F.col("templated") & (F.col("kind") == "Pod") & F.col("at").startswith("spec."), F.expr("substring(at, 6)"))
    spec = kept(rows.hint("merge").join(heads.where(F.col("kind").isin(*WORKLOADS)), doc).withColumn("rel", inner).where("rel IS NOT NULL").select(*doc, "kind", "name", "rel", "value", "quoted"), "spec")
    is_on = lambda p: F.coalesce(F.bool_or((F.col("rel") == p) & truthy()), F.lit(False))
    has = lambda p: F.coalesce(F.bool_or((F.col("rel") == p) & F.col("value").isNotNull()), F.lit(False))
    pods = spec.groupBy(*doc).agg(is_on("hostNetwork").alias("network"), is_on("hostPID").alias("pid"), is_on("hostIPC").alias("ipc"), has("securityContext.runAsNonRoot").alias("pod_user"))
    mine = r"^(containers|initContainers)\.(\d+)\.(.+)$"
    inside = spec.withColumns({"list": F.regexp_extract("rel", mine, 1), "no": F.regexp_extract("rel", mine, 2), "rel": F.regexp_extract("rel", mine, 3)}).where("list <> ''")
    one = [*doc, "list", "no"]
    containers = inside.groupBy(*one, "kind", "name").agg(F.coalesce(F.max(F.when(F.col("rel") == "name", F.col("value"))), F.lit("unknown")).alias("container"), is_on("securityContext.privileged").alias("privileged"), has("securityContext.runAsNonRoot").alias("user"), is_on("resources.limits.memory").alias("memory"), is_on("resources.limits.cpu").alias("cpu"), is_on("securityContext.readOnlyRootFilesystem").alias("read_only"))
    resource = F.concat_ws("/", "kind", "name", "container")
    checks = {"CKV_K8S_1": F.col("privileged"), "CKV_K8S_2": F.col("network"), "CKV_K8S_3": F.col("pid"), "CKV_K8S_4": F.col("ipc"), "CKV_K8S_5": ~F.col("user") & ~F.col("pod_user"), "CKV_K8S_6": ~F.col("memory") | ~F.col("cpu"), "CKV_K8S_7": ~F.col("read_only")}
    of_containers = containers.hint("merge").join(pods, doc).select(key, _each(checks).alias("policy"), resource.alias("resource"))
    setting = r"^env\.(\d+)\.(name|value)$"
    env = inside.withColumn("env", F.regexp_extract("rel", setting, 1)).where("env <> ''").groupBy(*one, "env").agg(*(F.coalesce(F.max(F.when(F.regexp_extract("rel", setting, 2) == k, F.col("value"))), F.lit("")).alias(f"env_{k}") for k in ("name", "value")))
    of_env = env.where(_secret(F.concat_ws("=", "env_name", "env_value"))).hint("merge").join(containers, one).select(key, F.lit("CKV_K8S_8").alias("policy"), F.concat_ws("/env/", resource, "env_name").alias("resource"))
    wild = rows.where("value = '*'").select(*doc, F.regexp_extract("at", r"^rules\.(\d+)\.(apiGroups|resources|verbs)\.\d+$", 1).alias("no"), F.regexp_extract("at", r"^rules\.\d+\.(\w+)\.", 1).alias("field")).where("no <> ''").groupBy(*doc, "no").agg(F.count_distinct("field").alias("n")).where("n = 3")
    of_roles = wild.hint("merge").join(heads.where("kind IN ('Role', 'ClusterRole')"), doc).select(key, F.lit("CKV_K8S_9").alias("policy"), F.concat_ws("/", "kind", "name").alias("resource"))
    of_accounts = heads.where("kind = 'ServiceAccount' AND NOT unmounted").select(key, F.lit("CKV_K8S_9").alias("policy"), F.concat_ws("/", "kind", "name").alias("resource"))
    of_pods = heads.where(F.col("kind").isin("Pod", "Deployment") & ~F.lower(key).contains("network")).select(key, F.lit("CKV_K8S_10").alias("policy"), F.concat_ws("/", "kind", "name").alias("resource"))
    found = of_containers.unionByName(of_env).unionByName(of_roles).unionByName(of_accounts).unionByName(of_pods)
    return _judged(found.withColumn("line_number", F.lit(1)), key)


def helm_findings(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Findings of charts' values."""
    rows = yaml_paths(df, key, text).where("doc = 0")
    some = lambda p, more=None: F.coalesce(F.bool_or(F.col("at").rlike(p) if more is None else F.col("at").rlike(p) & more), F.lit(False))
    set_ = F.col("value").isNotNull()
    charts = rows.where(~F.col("at").rlike(r"^\d+(\.|$)")).groupBy(key).agg(
        some(r"^securityContext(\.|$)|^[^.]+\.(podSecurityContext|securityContext)(\.|$)").alias("context"),
        some(r"^image$", set_).alias("named"), F.max(F.when(F.col("at") == "image.tag", F.col("value"))).alias("tag"),
        (some(r"^resources\.[^.]+") | some(r"^[^.]+\.resources\.limits(\.|$)")).alias("limits"),
    )
    checks = {"CKV_HELM_1": ~F.col("context"), "CKV_HELM_2": ~F.col("named") & F.coalesce("tag", F.lit("")).isin("latest", ""), "CKV_HELM_3": ~F.col("limits")}
    found = charts.select(key, _each(checks).alias("policy")).withColumn("resource", F.when(F.col("policy") == "CKV_HELM_2", "values.yaml/image").otherwise("values.yaml"))
    return _judged(found.withColumn("line_number", F.lit(1)), key)


def terraform_findings(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Findings of Terraform files' resources. A block's header line opens it; what else stands on that line is not looked at.

    Files are dealt by key once, over as many tasks as a shuffle has; all windows and checks are made where a file then lies.
    """
    in_file = Window.partitionBy(key).orderBy("line_number")
    files = dealt(df.select(key, text), key).distinct().select(key, text, F.lower(text).contains("encrypted").alias("says"))
    lines = numbered_lines(files, text).drop(text).withColumn("line", F.trim("line"))
    header = r'^resource\s+"([^"]+)"\s+"([^"]+)"'
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    lines = lines.withColumn("opens", F.col("line").rlike(header))
    lines = lines.withColumn("block", F.sum(F.col("opens").cast("int")).over(in_file)).where("block > 0")
    in_block = Window.partitionBy(key, "block").orderBy("line_number")
    lines = lines.withColumn("depth", 1 + F.sum(F.when(F.col("opens"), 0).otherwise(count("{") - count("}"))).over(in_block))
    lines = lines.withColumns({"least": F.min("depth").over(in_block), "kind": F.first(F.regexp_extract("line", header, 1)).over(in_block), "name": F.first(F.regexp_extract("line", header, 2)).over(in_block)}).where("least > 0")
    at = F.col("line")
    checks = {
        "CKV_TF_1": (F.col("kind") == "aws_s3_bucket") & at.rlike(r'acl\s*=\s*"public-read(-write)?"'),
        "CKV_TF_2": (F.col("kind") == "aws_security_group") & at.contains("0.0.0.0/0"),
        "CKV_TF_3": F.col("kind").isin(*STORAGE) & at.rlike(r"encrypted\s*=\s*false"),
        "CKV_TF_4": at.rlike(r'(?i)(password|secret|token|key)\s*=\s*"[^"]+"') & ~at.contains("var.") & ~at.contains("data."),
    }
    resource = F.concat_ws(".", "kind", "name")
    inside = F.array(*(F.when(~F.col("opens") & c, F.lit(p)) for p, c in checks.items()))
    silent = F.array(F.when(F.col("opens") & F.col("kind").isin(*MUST_SAY) & ~F.col("says"), F.lit("CKV_TF_3")))
    found = lines.select(key, F.explode(F.array_compact(F.concat(inside, silent))).alias("policy"), resource.alias("resource"), F.when(F.col("opens"), 1).otherwise(F.col("line_number")).alias("line_number"))
    return _judged(found, key)


def docker_findings(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Findings of Dockerfiles by instruction; what is missing is reported for line 1."""
    lines = numbered_lines(df.select(key, F.coalesce(text, F.lit("")).alias(text)).distinct(), text).drop(text).withColumn("line", F.trim("line"))
    word = r"^([A-Za-z]+)\s+(.+)$"
    lines = lines.withColumns({"says": F.when(F.col("line").startswith("#"), "").otherwise(F.upper(F.regexp_extract("line", word, 1))), "args": F.trim(F.regexp_extract("line", word, 2))})
    says, image = F.col("says"), F.split("args", r"\s+")[0]
    checks = {"CKV_DOCKER_1": (says == "FROM") & (~image.contains(":") | image.endswith(":latest")), "CKV_DOCKER_4": says == "ADD", "CKV_DOCKER_5": says.isin("ENV", "ARG") & _secret(F.col("args")), "CKV_DOCKER_8": (says == "RUN") & F.lower("args").contains("sudo")}
    found = lines.select(key, _each(checks).alias("policy"), F.concat_ws(" ", "says", "args").alias("resource"), "line_number")
    whole = lines.groupBy(key).agg(F.count_if(says == "USER").alias("users"), F.count_if(says == "HEALTHCHECK").alias("health"), F.count_if(says == "FROM").alias("stages"))
    missing = whole.select(key, _each({"CKV_DOCKER_3": F.col("users") == 0, "CKV_DOCKER_2": F.col("health") == 0, "CKV_DOCKER_6": F.col("stages") <= 1}).alias("policy"), F.lit("Dockerfile").alias("resource"), F.lit(1).alias("line_number"))
    return _judged(found.unionByName(missing), key)


_POD = "apiVersion: v1\nkind: {kind}\nmetadata:\n  name: app\nspec:\n{spec}"
_GOOD = ("  - name: web", "    securityContext:", "      runAsNonRoot: true", "      readOnlyRootFilesystem: true", "    resources:", "      limits: {memory: 1Gi, cpu: 1}")


def _pod(kind: str = "Pod", spec: tuple[str, ...] = (), container: tuple[str, ...] = _GOOD) -> str:
    body = ["containers:", *container, *spec]
    if kind != "Pod":
        body = ["replicas: 1", "template:", "  metadata: {}", "  spec:", *("    " + x for x in body)]
    return _POD.format(kind=kind, spec="\n".join("  " + x for x in body))


_without = lambda *words: tuple(x for x in _GOOD if not any(w in x for w in words))
#: Manifests, and the policies that each breaks with the resource, beside the network policy of pods and deployments.
MANIFESTS = (
    (_pod(), ()), (_pod(container=(*_GOOD[:2], "      privileged: true", *_GOOD[2:])), (("CKV_K8S_1", "/web"),)), (_pod("Deployment", ("hostNetwork: true",)), (("CKV_K8S_2", "/web"),)), (_pod("Job", ("hostPID: yes",)), (("CKV_K8S_3", "/web"),)),
    (_pod(spec=("hostIPC: true",)), (("CKV_K8S_4", "/web"),)), (_pod(container=_without("NonRoot")), (("CKV_K8S_5", "/web"),)), (_pod("StatefulSet", ("securityContext:", "  runAsNonRoot: true"), _without("NonRoot")), ()), (_pod(container=_without("limits", "resources")), (("CKV_K8S_6", "/web"),)),
    (_pod(container=_without("readOnly")), (("CKV_K8S_7", "/web"),)), (_pod("DaemonSet", container=(*_GOOD, "    env:", "    - name: DB_PASSWORD", "      value: 'x1'", "    - name: MODE", "      value: fast")), (("CKV_K8S_8", "/web/env/DB_PASSWORD"),)),
    ("kind: ServiceAccount\nmetadata:\n  name: app", (("CKV_K8S_9", ""),)), ("kind: ServiceAccount\nmetadata:\n  name: app\nautomountServiceAccountToken: false", ()), ("kind: ClusterRole\nmetadata: {name: app}\nrules:\n- apiGroups: ['*']\n  resources: ['pods', '*']\n  verbs:\n  - \"*\"\n- apiGroups: ['*']\n  resources: [x]\n  verbs: ['*']", (("CKV_K8S_9", ""),)),
    (_pod(container=(*_GOOD, *(x.replace("web", "side") for x in _without("NonRoot")))), (("CKV_K8S_5", "/side"),)),
)
#: Terraform files and what each breaks: policy, resource, line.
RESOURCES = (
    ('resource "aws_s3_bucket" "b" {\n  acl = "private"\n}\nacl = "public-read"', ()), ('resource "aws_s3_bucket" "b" {\n  tags = {\n    a = 1\n  }\n  acl = "public-read"\n}', (("CKV_TF_1", "aws_s3_bucket.b", 5),)), ('resource "aws_security_group" "g" {\n  ingress {\n    cidr_blocks = ["0.0.0.0/0"]\n  }\n}', (("CKV_TF_2", "aws_security_group.g", 3),)),
    ('resource "aws_ebs_volume" "v" {\n  encrypted = false\n}', (("CKV_TF_3", "aws_ebs_volume.v", 2),)), ('variable "x" {}\nresource "aws_db_instance" "d" {\n  size = 1\n}', (("CKV_TF_3", "aws_db_instance.d", 1),)), ('resource "aws_lambda" "l" {\n  api_key = "k1"\n  token = "${var.t}"\n}\npassword = "x"', (("CKV_TF_4", "aws_lambda.l", 2),)),
    ('resource "aws_rds_cluster" "c" {\n  encrypted = true\n  password = var.p\n}\nresource "aws_security_group" "g" {\n}\ndata "x" "y" {\n  cidr = "0.0.0.0/0"\n}', ()),
)
#: Values of charts and the policies that each breaks.
VALUES = (
    ("image:\n  tag: '1.2'\nsecurityContext:\n  a: 1\nresources:\n  limits: {cpu: 1}", ()), ("image:\n  tag: '1.2'\nresources:\n  limits: {cpu: 1}", ("CKV_HELM_1",)), ("image:\n  tag: latest\nweb:\n  podSecurityContext: {a: 1}\n  resources:\n    limits:\n      cpu: 1", ("CKV_HELM_2",)), ("image: nginx\nsecurityContext: {a: 1}\nresources: {}", ("CKV_HELM_3",)),
    ("replicas: 2\nweb:\n  resources:\n    requests: {cpu: 1}", ("CKV_HELM_1", "CKV_HELM_2", "CKV_HELM_3")), ("- a\n- b", ()),
)
#: Dockerfiles and what each breaks: policy and line.
DOCKERFILES = (
    ("FROM a:1 AS b\nFROM c:2\nUSER app\nHEALTHCHECK CMD x", ()), ("FROM a\nFROM c:latest\nUSER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_1", 1), ("CKV_DOCKER_1", 2))), ("FROM a:1\nFROM c:2\nuser app", (("CKV_DOCKER_2", 1),)), ("FROM a:1\nFROM c:2\n# USER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_3", 1),)),
    ("FROM a:1\nFROM c:2\nADD . /x\nUSER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_4", 3),)), ("FROM a:1\nARG API_KEY=k\nFROM c:2\nENV MODE=x\nUSER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_5", 2),)), ("FROM a:1\nUSER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_6", 1),)), ("FROM a:1\nFROM c:2\nRUN apt && SUDO make\nUSER app\nHEALTHCHECK CMD x", (("CKV_DOCKER_8", 3),)),
)


def _files(spark: SparkSession, sf_dir: str, texts: list[str], ending: str) -> DataFrame:
    """Files made from the parts, in turn of the texts."""
    k = F.col("p_partkey")
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("p"), k.cast("string"), F.lit(ending)).alias("path"), F.element_at(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int") + 1).alias("text"))


def _planted_sql(n: int, ending: str, broken: list[tuple[int, str, str, int]]) -> str:
    rows = ", ".join(f"({k}, '{p}', '{POLICIES[p][0]}', '{POLICIES[p][1]}', '{resource}', {line})" for k, p, resource, line in broken)
    return f"SELECT 'p' || p_partkey || '{ending}' AS path, f.policy, f.severity, f.cwe_id, f.resource, f.line_number FROM part JOIN (VALUES {rows}) f(k, policy, severity, cwe_id, resource, line_number) ON f.k = p_partkey % {n}"


def _manifest_rows() -> list[tuple[int, str, str, int]]:
    out = []
    for k, (text, broken) in enumerate(MANIFESTS):
        kind = re.search(r"kind: (\w+)", text)[1]
        out += [(k, p, f"{kind}/app{more}", 1) for p, more in broken]
        if kind in ("Pod", "Deployment"):
            out.append((k, "CKV_K8S_10", f"{kind}/app", 1))
    return out


@query("txt11_kubernetes", _planted_sql(len(MANIFESTS), ".yaml", _manifest_rows()))
def txt11_kubernetes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kubernetes_findings(_files(spark, sf_dir, [t for t, _ in MANIFESTS], ".yaml"))


@query("txt11_helm", _planted_sql(len(VALUES), "/values.yaml", [(k, p, "values.yaml/image" if p == "CKV_HELM_2" else "values.yaml", 1) for k, (_, broken) in enumerate(VALUES) for p in broken]))
def txt11_helm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helm_findings(_files(spark, sf_dir, [t for t, _ in VALUES], "/values.yaml"))


@query("txt11_terraform", _planted_sql(len(RESOURCES), ".tf", [(k, *b) for k, (_, broken) in enumerate(RESOURCES) for b in broken]))
def txt11_terraform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terraform_findings(_files(spark, sf_dir, [t for t, _ in RESOURCES], ".tf"))


def _says(text: str, policy: str, line: int) -> str:
    if policy in ("CKV_DOCKER_2", "CKV_DOCKER_3", "CKV_DOCKER_6"):
        return "Dockerfile"
    word, _, rest = text.split("\n")[line - 1].partition(" ")
    return f"{word.upper()} {rest}"


@query("txt11_docker", _planted_sql(len(DOCKERFILES), "/Dockerfile", [(k, p, _says(text, p, line), line) for k, (text, broken) in enumerate(DOCKERFILES) for p, line in broken]))
def txt11_docker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docker_findings(_files(spark, sf_dir, [t for t, _ in DOCKERFILES], "/Dockerfile"))


@query("agg47_policy_summary", f"SELECT policy, severity, count(*) AS findings, count(DISTINCT path) AS files FROM ({_planted_sql(len(MANIFESTS), '.yaml', _manifest_rows())}) GROUP BY 1, 2")
def agg47_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and files of every policy that is broken."""
    return kubernetes_findings(_files(spark, sf_dir, [t for t, _ in MANIFESTS], ".yaml")).groupBy("policy", "severity").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))
