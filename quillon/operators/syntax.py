"""Checks of source text beyond the line catalog: Python's syntax tree, families of patterns about language models, frameworks, imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.operators.scan import LEAST, LINES_SQL, hits_sql, required, scan_lines, scan_texts
from quillon.sources.readers import numbered_lines
from quillon.sources.tables import dealt, table

# Patterns of code about language models, by family. Those that span lines stand apart below.
AI_SIGNATURES = (
    r"#\s*This function\s+(?:is used to|will|handles?|takes|accepts)",
    r"^\s*(?:This|A|An)\s+(?:function|method|class|module|script)\s+(?:that\s+)?(?:is\s+used\s+to|handles?|processes?|manages?|takes|accepts|returns|will)\b",
    r"#\s*TODO:\s*(?:Add (?:error|validation|authentication|authorization)|Implement)",
    r"#\s*Import necessary (?:libraries|modules|packages)",
    r"#\s*Note: This (?:may|might|should) work",
)
HALLUCINATED_APIS = (
    r"requests\.send_request\(",
    r"json\.parse\(",
    r"os\.get_dir\(",
    r"datetime\.now\.format\(",
    r"flask\.create_app\(",
    r"django\.setup_app\(",
    r"pandas\.Dataframe\(",
    r"numpy\.array\.tolist\(",
    r"re\.find\(",
    r"socket\.connect_to\(",
    r"fs\.read\(",
    r"express\.createServer\(",
    r"document\.find\(",
    r"window\.fetchJSON\(",
    r"ArrayList\.sortBy\(",
    r"String\.isEmpty\s*\(\s*\)",
)
AI_CORS = (
    r"(?i)(Access-Control-Allow-Origin\s*:\s*\*)",
    r"(?i)(cors\s*\(\s*\{\s*origin\s*:\s*['\"]?\*['\"]?)",
    r"(?i)(@CrossOrigin\s*\(\s*origins\s*=\s*['\"]?\*['\"]?)",
    r"(?i)(res\.header\s*\(\s*['\"]Access-Control-Allow-Origin['\"]\s*,\s*['\"]\*['\"])",
    r"(?i)(app\.use\s*\(\s*cors\s*\(\s*\)\s*\))",
    r"(?i)(cors\.AllowAllOrigins\s*=\s*true)",
)
INSECURE_DEFAULTS = (
    r"(?i)(SECRET_KEY\s*=\s*['\"](?:secret|key|change-me|your-secret|example))",
    r"(?i)(DEBUG\s*=\s*True)",
    r"(?i)(ALLOWED_HOSTS\s*=\s*\[['\"]\*['\"]\])",
    r"(?i)(SESSION_COOKIE_SECURE\s*=\s*False)",
    r"(?i)(CSRF_COOKIE_SECURE\s*=\s*False)",
    r"(?i)(ADMIN_PASSWORD\s*=\s*['\"](?:admin|password|123456))",
    r"(?i)(DEFAULT_PASSWORD\s*=\s*['\"](?:password|admin|1234))",
    r"(?i)(verify\s*=\s*False)",
    r"(?i)(ssl_verify\s*=\s*False)",
    r"(?i)(privileged:\s*true)",
    r"(?i)(runAsUser:\s*0)",
    r"(?i)(allowPrivilegeEscalation:\s*true)",
)
LLM_KEYS = (
    r"(?i)(openai[_-]?api[_-]?key\s*[:=]\s*['\"]sk-[a-zA-Z0-9]{20,}['\"])",
    r"(?i)(anthropic[_-]?api[_-]?key\s*[:=]\s*['\"]sk-ant-[a-zA-Z0-9]{20,}['\"])",
    r"(?i)(cohere[_-]?api[_-]?key\s*[:=]\s*['\"][a-zA-Z0-9]{20,}['\"])",
    r"(?i)(huggingface[_-]?token\s*[:=]\s*['\"]hf_[a-zA-Z0-9]{20,}['\"])",
    r"(?i)(google[_-]?api[_-]?key\s*[:=]\s*['\"]AIza[0-9A-Za-z_-]{33,}['\"])",
    r"(?i)(replicate[_-]?api[_-]?token\s*[:=]\s*['\"]r8_[a-zA-Z0-9]{20,}['\"])",
    r"(?i)(together[_-]?api[_-]?key\s*[:=]\s*['\"][a-zA-Z0-9]{20,}['\"])",
    r"(?i)(mistral[_-]?api[_-]?key\s*[:=]\s*['\"][a-zA-Z0-9]{20,}['\"])",
    r"(?i)(groq[_-]?api[_-]?key\s*[:=]\s*['\"]gsk_[a-zA-Z0-9]{20,}['\"])",
    r"(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*['\"]sk-[a-zA-Z0-9]{16,}['\"]",
)
LLM_INPUT = (
    r"(?i)(openai\.(?:ChatCompletion|chat\.completions)\.create\s*\(\s*messages\s*=)(?!.*(?:validate|sanitize|check|filter|length|limit))",
    r"(?i)(anthropic\.(?:Client|messages)\.create\s*\(\s*)",
    r"(?i)(requests\.(?:get|post)\s*\(\s*['\"]https://api\.openai\.com)(?!.*(?:validate|sanitize|check))",
)
LLM_OUTPUT = (
    r"(?i)(eval\s*\(\s*(?:response|completion|result|output)\s*\))",
    r"(?i)(exec\s*\(\s*(?:response|completion|result|output)\s*\))",
    r"(?i)(cursor\.execute\s*\(\s*(?:response|completion|result|output))",
    r"(?i)((?:innerHTML|dangerouslySetInnerHTML|\.html\s*\(\s*)\s*=\s*(?:response|completion|result|output))",
    r"(?i)(os\.system\s*\(\s*(?:response|completion|result|output))|(subprocess\.(?:run|call|Popen)\s*\(\s*(?:response|completion|result|output))",
    r"(?i)(open\s*\(\s*(?:response|completion|result|output)\s*,\s*['\"]w)|(write|writelines)\s*\(\s*(?:response|completion|result|output)\s*\)",
)
RAG = (
    r"(?i)(system_prompt\s*=\s*f?['\"].*\{.*(?:user_input|query|input|text|request).*)",
    r"(?i)(context\s*=\s*f?['\"].*\{.*(?:document|chunk|retrieved|search).*)(?!.*(?:sanitize|escape|filter))",
    r"(?i)(prompt\s*=\s*f?['\"].*System:.*User:.*)(?!.*(?:delimiter|separator|<\|))",
    r"(?i)(f?['\"]You are.*helpful.*assistant['\"].*\+\s*(?:user_input|query))",
)
BOUNDARY = (
    r"(?i)(system_prompt\s*=\s*['\"].{0,200}['\"])(?!.*(?:ignore previous|disregard|do not follow))",
    r"(?i)(messages\s*=\s*\[.*\{.*['\"]system['\"].*\}.*\{.*['\"]user['\"].*\}\])(?!.*(?:seal|delimiter|<\|))",
)
OWASP_LLM = {
    "LLM01": (r"(?i)(system.*prompt.*\{.*user|user.*input.*system.*prompt)|(f['\"].*You are.*\{.*\}.*respond)", r"(?i)(retrieved.*context.*user.*input|document.*inject.*prompt)|(context.*data.*passed.*llm.*unsanitized)"),
    "LLM02": (r"(?i)(eval\s*\(\s*response|exec\s*\(\s*llm|response.*innerHTML)|(llm_output.*system|completion.*subprocess)", r"(?i)(json\.loads\s*\(\s*(?:response|completion)\s*\).*(?:except\s*JSONDecodeError)?)(?!.*except)"),
    "LLM03": (r"(?i)(fine.?tune.*custom.*dataset|train.*on.*user.*data)(?!.*(?:validate|sanitize|audit))", r"(?i)(load_dataset\s*\(\s*(?:url|path)\s*=.*(?!verify))"),
    "LLM04": (r"(?i)(max_tokens\s*=\s*\d{5,}|no.*token.*limit|unbounded.*request)|(while\s+True.*llm|recursive.*call.*api)", r"(?i)(requests\.(?:get|post)\s*\(.*timeout\s*=\s*(?:None|0)\))|(openai.*create.*(?!max_tokens))"),
    "LLM05": (r"(?i)(pip\s+install\s+.*--index-url|npm\s+install\s+.*--registry)(?!.*trusted|official)", r"(?i)(pickle\.(?:load|loads)\s*\(|yaml\.load\s*\(.*Loader\s*=\s*yaml\.(?:Loader|UnsafeLoader))"),
    "LLM06": (r"(?i)(return\s+.*error.*traceback.*to.*client|send.*exception.*user)|(debug\s*=\s*True.*production|log.*api_key|print\s*\(\s*(?:secret|token|key))", r"(?i)(response.*include.*system.*prompt|reveal.*instructions.*to.*user)", r"(?i)((?:return|response|jsonify|render|send)\b.*traceback\.format_exc\s*\(\s*\))|(traceback\.format_exc\s*\(\s*\).*(?:return|response|jsonify))"),
    "LLM07": (r"(?i)(plugin.*exec\s*\(|tool.*eval\s*\(|extension.*system.*call)|(register.*tool\s*\(\s*function\s*=.*eval)", r"(?i)(tool.*no.*validation|plugin.*input.*unsanitized)|(allow_all.*tools|disable_security.*plugin)"),
    "LLM08": (r"(?i)(auto.*execute|auto.*run|auto.*deploy|self.*acting)|(allow.*llm.*write.*file|llm.*modify.*database)", r"(?i)(tool.*delete.*permission|llm.*admin.*access|grant.*all.*privileges)|(bypass.*approval|skip.*confirmation)"),
    "LLM09": (r"(?i)(trust.*llm.*output|use.*llm.*for.*security.*decision)|(llm.*authenticate|llm.*authorize|llm.*validate.*input)", r"(?i)(no.*human.*review|fully.*automated.*llm|blind.*trust)|(skip.*verification.*llm.*output)", r"(?i)(?:auth\w*|authz|decision|verdict|access|permission|approv\w*)\s*=\s*[^=\n]*\b(?:llm|model|gpt|openai|claude|chat|completion)\w*\.\s*(?:evaluate|decide|predict|classify|complete|generate|judge|assess)"),
    "LLM10": (r"(?i)(model.*download.*endpoint|/download.*model|export.*weights)(?!.*(?:auth|authenticate|authorize))", r"(?i)(model.*served.*publicly|api.*expose.*architecture)|(replicate\s*model|clone\s*weights)"),
}
MCP = (
    (r"(?i)(tool.*description\s*=\s*f?['\"].*\{.*user_input|function.*docstring.*injected.*parameter)", "MCP-Tool-Poisoning"),
    (r"(?i)(tool.*description.*ignore.*previous|function.*schema.*override|mcp.*tool.*redefined.*runtime)", "MCP-Malicious-Description"),
    (r"(?i)(mcp.*tool.*admin|tool.*bypass.*auth|mcp.*escalate.*privilege|tool.*grant.*permission.*higher)", "MCP-Privilege-Escalation"),
    (r"(?i)(mcp.*allow_all_tools|tool.*permission\s*=\s*['\"]?\*['\"]?|all_tools.*enabled.*true|disable_tool_validation)", "MCP-Unrestricted-Tools"),
    (r"(?i)(mcp.*call_tool.*\(.*\w+\s*=\s*(?!.*validate|sanitize).*\w+_input|execute.*tool.*args.*raw)", "MCP-Unvalidated-Input"),
    (r"(?i)(mcp.*server.*no.*auth|mcp.*transport.*without.*verify|mcp.*stdio.*no.*validation)", "MCP-Unauthenticated-Server"),
    (r"(?i)(tool.*result.*direct.*llm.*no.*filter|mcp.*output.*passed.*to.*system.*unsanitized)", "MCP-Trust-Boundary"),
)
# CWE and severity of the OWASP groups, severity of the MCP groups.
LLM_CWE = {"LLM01": "CWE-94", "LLM02": "CWE-89", "LLM03": "CWE-506", "LLM04": "CWE-400", "LLM05": "CWE-829", "LLM06": "CWE-200", "LLM07": "CWE-749", "LLM08": "CWE-250", "LLM09": "CWE-345", "LLM10": "CWE-306"}
LLM_SEVERITY = {
    "LLM01": "CRITICAL", "LLM02": "HIGH", "LLM03": "MEDIUM", "LLM04": "HIGH", "LLM05": "HIGH", "LLM06": "HIGH", "LLM07": "CRITICAL", "LLM08": "CRITICAL", "LLM09": "MEDIUM", "LLM10": "HIGH",
    "MCP-Tool-Poisoning": "HIGH", "MCP-Malicious-Description": "HIGH", "MCP-Privilege-Escalation": "CRITICAL", "MCP-Unrestricted-Tools": "HIGH", "MCP-Unvalidated-Input": "HIGH", "MCP-Unauthenticated-Server": "MEDIUM", "MCP-Trust-Boundary": "HIGH",
}
# Markers of frameworks, and the files that are searched for those that are no paths.
FRAMEWORKS = {
    "React": ("package.json", ".jsx", ".tsx", "react", "React"), "React Native": ("package.json", "react-native"), "Vue": ("package.json", "vue"), "Angular": ("angular.json", "package.json", "@angular"), "Node.js": ("package.json", "node_modules", "server.js"),
    "Express": ("package.json", "express"), "Django": ("manage.py", "settings.py", "wsgi.py", "django"), "Flask": ("app.py", "flask", "Flask"), "FastAPI": ("fastapi", "FastAPI"), "Spring Boot": ("pom.xml", "build.gradle", "spring-boot"),
    "Spring": ("pom.xml", "build.gradle", "Application.java"), "Rails": ("Gemfile", "config/routes.rb", "app/controllers"), "Laravel": ("composer.json", "artisan"), ".NET": (".csproj", ".sln"), "ASP.NET Core": ("Startup.cs", "Program.cs", ".csproj"),
}
CONFIGS = ("package.json", "requirements.txt", "pom.xml", "Gemfile", "composer.json")
# Placeholders of authentication, tried on WINDOW lines at once; patterns that are tried on whole texts; calls
# whose failure is to be handled.
PLACEHOLDER_AUTH = (
    r"(?i)(if\s+.*:\s*\n\s*return\s+True\s*\n\s*#\s*TODO.*auth)|(def\s+is_authenticated\s*\(\s*\)\s*:\s*\n\s*return\s+True)",
    r"(?i)(#\s*@login_required\n|#\s*@require_auth\n|#\s*auth_check\s*\()",
    r"(?i)(def\s+auth_middleware\s*\(.*\)\s*:\s*\n\s*pass\s*$|class\s+AuthMiddleware\s*:\s*\n\s*def\s+__call__\s*\(\s*self.*\)\s*:\s*\n\s*return)",
    r"(?i)(jwt\.decode\s*\(\s*token\s*,\s*['\"](?:secret|key|placeholder))",
    r"(?i)(def\s+check_permission\s*\(.*\)\s*:\s*\n\s*return\s+True)|(def\s+has_permission\s*\(.*\)\s*:\s*\n\s*return\s+True)",
)
SPANNING_SIGNATURES = (r'"""\s*\n\s*(?:This (?:function|method|class)|A (?:function|method|class) that)',)
SPANNING_DEFAULTS = (r"(?i)(FROM\s+python:.*\n.*RUN\s+pip\s+install.*--no-cache)",)
UNHANDLED = (
    r"(cursor\.execute|session\.(query|add|commit)|Model\.query)",
    r"(open\s*\(|fs\.(readFile|writeFile)|with\s+open)",
    r"(requests\.(get|post|put|delete)|fetch\s*\(|axios\.(get|post))",
    r"(openai\.(ChatCompletion|Completion)|anthropic|completion)",
)
WINDOW = 3
#: Names in insecure defaults that are secrets.
SECRET_DEFAULTS = ("SECRET_KEY", "PASSWORD")
#: Names of variables that hold secrets.
SECRET_NAMES = ("password", "secret", "api_key", "token")


#: Severity and CWE of the families outside those groups.
FAMILIES = {
    "AI signature": (AI_SIGNATURES, "INFO", "CWE-1104"), "Hallucinated API": (HALLUCINATED_APIS, "MEDIUM", "CWE-1104"), "AI CORS": (AI_CORS, "MEDIUM", "CWE-346"), "Insecure default": (INSECURE_DEFAULTS, "MEDIUM", "CWE-1188"), "LLM key": (LLM_KEYS, "CRITICAL", "CWE-798"),
    "LLM input": (LLM_INPUT, "HIGH", "CWE-20"), "LLM output": (LLM_OUTPUT, "CRITICAL", "CWE-94"), "RAG injection": (RAG, "CRITICAL", "CWE-94"), "Prompt boundary": (BOUNDARY, "MEDIUM", "CWE-94"),
}


def families() -> list[tuple[str, str, str, str]]:
    """family, pattern, severity and CWE of every pattern that is tried on lines; defaults that are secrets are worse than the others."""
    secret = lambda family, p: family == "Insecure default" and any(w in p for w in SECRET_DEFAULTS)
    out = [(family, p, *(("HIGH", "CWE-798") if secret(family, p) else (severity, cwe))) for family, (patterns, severity, cwe) in FAMILIES.items() for p in patterns]
    out += [(group, p, LLM_SEVERITY[group], LLM_CWE[group]) for group, patterns in OWASP_LLM.items() for p in patterns]
    return out + [(group, p, LLM_SEVERITY[group], "CWE-749") for p, group in MCP]


def family_rules(chosen: list[tuple[str, str, str, str]]) -> tuple[tuple[str, str, str, str], ...]:
    """Families as rules of a scan; a rule's name is its family and its place in it."""
    place: dict[str, int] = {}
    out = []
    for family, pattern, severity, cwe in chosen:
        place[family] = place.get(family, 0) + 1
        out.append((f"{family}/{place[family]}", pattern, severity, cwe))
    return tuple(out)


def first_of_family(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_number, family, severity and cwe_id: of the hits of a family in a line the first pattern's."""
    parts = hits.withColumns({"family": F.split_part("rule", F.lit("/"), F.lit(1)), "place": F.split_part("rule", F.lit("/"), F.lit(2)).cast("int")})
    best = parts.groupBy(*keys, "line_number", "family").agg(F.min_by(F.struct("severity", "cwe_id"), "place").alias("b"))
    return best.select(*keys, "line_number", "family", "b.*")


def family_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """family_hits() over whole texts, with all families of lines in one pass whatever their number; the other columns are keys."""
    keys = [c for c in df.columns if c != text]
    return first_of_family(scan_lines(df, family_rules(families()), text, comments=True), keys)


def placeholder_auth(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines from which WINDOW lines hold a placeholder of authentication; the other columns of df are keys."""
    keys = [c for c in df.columns if c != text]
    return first_of_family(scan_lines(df, family_rules([("Placeholder auth", p, "CRITICAL", "CWE-306") for p in PLACEHOLDER_AUTH]), text, WINDOW, comments=True), keys)


def unhandled_calls(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines with a call whose failure is to be handled: the first kind of such calls that a line has."""
    keys = [c for c in df.columns if c != text]
    return first_of_family(scan_lines(df, family_rules([("Unhandled call", p, "LOW", "CWE-755") for p in UNHANDLED]), text), keys)


def spanning(df: DataFrame, text: str = "text") -> DataFrame:
    """Matches of the patterns that span lines in whole texts: line_number, last_line, rule, severity, cwe_id."""
    return scan_texts(df, family_rules([*(("AI signature, spanning", p, "INFO", "CWE-1104") for p in SPANNING_SIGNATURES), *(("Insecure default, spanning", p, "MEDIUM", "CWE-1188") for p in SPANNING_DEFAULTS)]), text)


def family_hits(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with family, severity and cwe_id, a row for each line and family: the first pattern of the family that a line has.

    A pattern is only tried on lines that hold, in any case, one of the runs of letters that it cannot do without.
    """
    at, low, by_family = F.col(line), F.col("__low"), {}

    def found(pattern: str) -> Column:
        runs = sorted(required(pattern) or ())
        if not runs or min(map(len, runs)) < LEAST:
            return at.rlike(pattern)
        some = low.contains(runs[0])
        for run in runs[1:]:
            some = some | low.contains(run)
        return some & at.rlike(pattern)

    for family, pattern, severity, cwe in families():
        hit = F.struct(F.lit(family).alias("family"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe_id"))
        by_family[family] = F.when(found(pattern), hit) if family not in by_family else by_family[family].when(found(pattern), hit)
    return lines.withColumn("__low", F.lower(line)).select("*", F.explode(F.array_compact(F.array(*by_family.values()))).alias("h")).select(*lines.columns, "h.*")


def syntax_findings(text: str) -> list[tuple[str, int, str, str]]:
    """check, line, severity and CWE of dangerous calls and of constants that are named as secrets; none if the text does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = set()
    for node in ast.walk(tree):
        match node:
            case ast.Call(func=ast.Name(id=name)) if name in ("eval", "exec"):
                found.add((f"{name}-call", node.lineno, "CRITICAL", "CWE-94"))
            case ast.Call(func=ast.Attribute(attr="loads", value=ast.Name(id=module) | ast.Attribute(attr=module))) if module in ("pickle", "cPickle", "yaml"):
                found.add((f"{module}-loads", node.lineno, "MEDIUM" if module == "yaml" else "HIGH", "CWE-502"))
            case ast.Assign(value=ast.Constant(value=value)) if len(str(value)) > 1:
                found |= {("hardcoded-secret", node.lineno, "CRITICAL", "CWE-798") for t in node.targets if isinstance(t, ast.Name) and any(w in t.id.lower() for w in SECRET_NAMES)}
    return sorted(found, key=lambda r: (r[1], r[0]))


def imports(text: str) -> list[tuple[str, bool]]:
    """Modules that a text imports (the part before the first dot) and whether one of the names bound occurs more than once."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    used: dict[str, bool] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            bound = [(a.name.split(".")[0], a.asname or a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            bound = [(node.module.split(".")[0], a.asname or a.name) for a in node.names]
        else:
            continue
        for module, name in bound:
            used[module] = used.get(module, False) or len(re.findall(rf"\b{re.escape(name)}\b", text)) > 1
    return sorted(used.items())


def each_text(df: DataFrame, key: str, text: str, function: object, names: list[str], schema: str) -> DataFrame:
    """key and a row for each result of a function over each text, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) for r in function(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def frameworks(files: DataFrame, project: str = "project", path: str = "path", text: str = "text", deepest: int = 3) -> DataFrame:
    """project and framework: one of its markers is the end of a file's name or part of a folder's (JSON files) or stands in a configuration file.

    Markers with a slash name no single file or folder, so they match none.
    """
    at, name = F.col(path), F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    near = F.size(F.split(at, "/")) - 1 <= deepest
    holds = name.isin(*CONFIGS) & near
    low = F.lower(F.col(text))

    def shown(marker: str) -> Column:
        if "/" in marker:
            return F.lit(False)
        if marker.endswith(".json"):
            return near & (name.endswith(marker) | F.regexp_replace(at, r"[^/]+$", "").contains(marker))
        return holds & low.contains(marker.lower())

    def any_of(markers: tuple[str, ...]) -> Column:
        out = shown(markers[0])
        for m in markers[1:]:
            out = out | shown(m)
        return out

    each = F.array_compact(F.array(*(F.when(any_of(markers), F.lit(f)) for f, markers in FRAMEWORKS.items())))
    return files.select(project, F.explode(each).alias("framework")).distinct()


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files with planted findings, one for each part: path and text; what is planted follows from the part's size and key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lines = [
        F.lit("import os, json as js"), F.lit("from pickle import loads as unpack"), F.lit("import yaml"),
        F.concat(F.lit("NAME = '"), "p_name", F.lit("'  # eval(x) in a comment")),
        F.when(size % 3 == 0, F.lit("value = eval(raw)")).otherwise(F.lit("value = 'eval(raw)'")),
        F.when(size % 5 == 0, F.lit("data = yaml.loads(raw)")).otherwise(F.lit("data = None")),
        F.when(size % 7 == 0, F.lit("db_Password = 'pw" + "x" * 8 + "'")).when(size % 7 == 1, F.lit("token = 5")).otherwise(F.lit("token = value")),
        F.when(size % 2 == 0, F.lit("print(js.dumps(data))")).otherwise(F.lit("print(data)")),
        F.when(k % 4 == 0, F.lit("DEBUG = True")).when(k % 4 == 1, F.lit("r = requests.send_request(url, verify=False)")).when(k % 4 == 2, F.lit("# TODO: Implement the rest")).otherwise(F.lit("cors({origin: '*'})")),
        F.when(k % 11 == 0, F.lit("def broken(:")).otherwise(F.lit("done = 1")),
    ]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


_PATH = "'src/p' || p_partkey || '.py'"


@query("txt08_syntax", f"""SELECT * FROM (SELECT {_PATH} AS path, 'eval-call' AS "check", 5 AS line_number, 'CRITICAL' AS severity, 'CWE-94' AS cwe_id FROM part WHERE p_size % 3 = 0 AND p_partkey % 11 <> 0
UNION ALL SELECT {_PATH}, 'yaml-loads', 6, 'MEDIUM', 'CWE-502' FROM part WHERE p_size % 5 = 0 AND p_partkey % 11 <> 0 UNION ALL SELECT {_PATH}, 'hardcoded-secret', 7, 'CRITICAL', 'CWE-798' FROM part WHERE p_size % 7 = 0 AND p_partkey % 11 <> 0)""")
def txt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and constants by Python's syntax tree; comments, strings and files that do not parse have none."""
    return each_text(code_files(spark, sf_dir), "path", "text", syntax_findings, ["check", "line_number", "severity", "cwe_id"], "check string, line_number int, severity string, cwe_id string")


@query("txt09_families", f"""SELECT {_PATH} AS path, 9 AS line_number, (['Insecure default', 'Hallucinated API', 'AI signature', 'AI CORS'])[p_partkey % 4 + 1] AS family, (['MEDIUM', 'MEDIUM', 'INFO', 'MEDIUM'])[p_partkey % 4 + 1] AS severity FROM part
UNION ALL SELECT {_PATH}, 9, 'Insecure default', 'MEDIUM' FROM part WHERE p_partkey % 4 = 1""")
def txt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of patterns about language models in lines of planted sources."""
    return family_hits(numbered_lines(code_files(spark, sf_dir)).drop("text")).select("path", "line_number", "family", "severity")


@query("txt09_family_lines", f"""SELECT {_PATH} AS path, 9 AS line_number, (['Insecure default', 'Hallucinated API', 'AI signature', 'AI CORS'])[p_partkey % 4 + 1] AS family, (['MEDIUM', 'MEDIUM', 'INFO', 'MEDIUM'])[p_partkey % 4 + 1] AS severity, (['CWE-1188', 'CWE-1104', 'CWE-1104', 'CWE-346'])[p_partkey % 4 + 1] AS cwe_id FROM part
UNION ALL SELECT {_PATH}, 9, 'Insecure default', 'MEDIUM', 'CWE-1188' FROM part WHERE p_partkey % 4 = 1""")
def txt09_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of lines over the planted sources, in one pass."""
    return family_lines(code_files(spark, sf_dir))


#: Faults that span lines: the part's key modulo their number says which a file holds, and its size modulo 5 how many lines
#: stand before it. The second number is the fault's first line after those, the third how many lines before it count too.
_SPANS = (
    ("def is_authenticated():\n    return True", 1, 1), ("def is_authenticated():\n    return user.ok", 0, 0), ("# @login_required\ndef view(request):", 1, 1), ("x = 1  # auth_check(user)", 1, 2), ("def auth_middleware(get):\n    pass", 1, 1),
    ("class AuthMiddleware:\n    def __call__(self, request):\n        return self.get(request)", 1, 0), ("claims = jwt.decode(token, 'secret')", 1, 2), ("def has_permission(user):\n    return True", 1, 1), ("def has_permission(user):\n\n\n    return True", 0, 0), ("if user.name:\n    return True\n# TODO add auth", 1, 0),
)


def spanning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from the parts, each with one fault, or something like it, that spans lines."""
    k, before = F.col("p_partkey"), F.repeat(F.lit("import os\n"), (F.col("p_size") % 5).cast("int"))
    fault = F.element_at(F.array(*(F.lit(f) for f, *_ in _SPANS)), (k % len(_SPANS)).cast("int") + 1)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(before, fault).alias("text"))


@query("txt09_placeholder_auth", f"SELECT {_PATH} AS path, cast(p_size % 5 + 1 - b.back as int) AS line_number, 'Placeholder auth' AS family, 'CRITICAL' AS severity, 'CWE-306' AS cwe_id FROM part JOIN (VALUES " + ", ".join(f"({i}, {more})" for i, (_, some, more) in enumerate(_SPANS) if some) + f") f(k, most) ON p_partkey % {len(_SPANS)} = f.k JOIN (VALUES (0), (1), (2)) b(back) ON b.back <= f.most AND b.back <= p_size % 5")
def txt09_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of authentication in windows of lines; a window that begins up to two lines before a fault may hold it."""
    return placeholder_auth(spanning_files(spark, sf_dir))


@query("txt09_unhandled_calls", "WITH lines AS (" + LINES_SQL.format(keys="doc_id", text="text", table="documents") + ") SELECT DISTINCT doc_id, line_number, 'Unhandled call' AS family, 'LOW' AS severity, 'CWE-755' AS cwe_id FROM (" + hits_sql(family_rules([("u", p, "LOW", "CWE-755") for p in UNHANDLED]), "lines", "doc_id, line_number") + ")")
def txt09_unhandled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unhandled_calls(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("txt09_spanning", f"SELECT {_PATH} AS path, cast(p_size % 5 + 1 as int) AS line_number, cast(p_size % 5 + 2 as int) AS last_line, CASE WHEN p_partkey % 3 = 0 THEN 'AI signature, spanning/1' ELSE 'Insecure default, spanning/1' END AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'INFO' ELSE 'MEDIUM' END AS severity, CASE WHEN p_partkey % 3 = 0 THEN 'CWE-1104' ELSE 'CWE-1188' END AS cwe_id FROM part WHERE p_partkey % 3 < 2")
def txt09_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns over the line ends of whole files."""
    k, before = F.col("p_partkey"), F.repeat(F.lit("x = 1\n"), (F.col("p_size") % 5).cast("int"))
    fault = F.when(k % 3 == 0, '"""\n    This function adds.').when(k % 3 == 1, "FROM python:3\nENV A=1; RUN pip install x --no-cache").otherwise("from python:3\n\nRUN pip install x --no-cache")
    return spanning(table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(before, fault).alias("text")))


@query("sec06_call_graph", "SELECT module, count(*) AS files, count(*) FILTER (used) AS used FROM (SELECT m.module, CASE m.module WHEN 'json' THEN p_size % 2 = 0 WHEN 'yaml' THEN p_size % 5 = 0 ELSE false END AS used FROM part, (VALUES ('os'), ('json'), ('pickle'), ('yaml')) m(module) WHERE p_partkey % 11 <> 0) GROUP BY 1")
def sec06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, the files that import them and those that use a name of theirs again."""
    found = each_text(code_files(spark, sf_dir), "path", "text", imports, ["module", "used"], "module string, used boolean")
    return found.groupBy("module").agg(F.count("*").alias("files"), F.count_if("used").alias("used"))


@query("sec05_frameworks", """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS project, f.framework FROM p, (VALUES ('React'), ('React Native'), ('Vue'), ('Angular'), ('Node.js'), ('Express')) f(framework) WHERE k % 4 = 0
UNION ALL SELECT k, 'Django' FROM p WHERE k % 4 = 1 UNION ALL SELECT k, 'FastAPI' FROM p WHERE k % 4 = 1 AND k % 3 = 0
UNION ALL SELECT k, 'Angular' FROM p WHERE k % 4 = 2 UNION ALL SELECT k, 'Spring Boot' FROM p WHERE k % 4 = 3""")
def sec05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects made from the parts: one with a package file, one with requirements, one with settings, one with a build file; markers too deep do not count."""
    k = F.col("p_partkey")
    files = F.array(
        F.struct(F.when(k % 4 == 0, "package.json").when(k % 4 == 1, "requirements.txt").when(k % 4 == 2, "web/angular.json").otherwise("pom.xml").alias("path"), F.when(k % 4 == 1, F.when(k % 3 == 0, "Django==5.0\nFASTAPI>=1").otherwise("django>4")).when(k % 4 == 3, "<a>spring-boot-starter</a>").otherwise("{}").alias("text")),
        F.struct(F.lit("a/b/c/d/e/composer.json").alias("path"), F.lit("artisan").alias("text")),
        F.struct(F.lit("src/main.py").alias("path"), F.lit("import flask").alias("text")),
    )
    made = table(spark, sf_dir, "part").select(k.alias("project"), F.explode(files).alias("f")).select("project", "f.*")
    return frameworks(made)
