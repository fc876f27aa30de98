"""Names, patterns and tables that results depend on."""

LANGUAGES = {
    "TypeScript": (".ts", ".tsx"), "JavaScript": (".js", ".jsx", ".mjs", ".cjs"), "Python": (".py", ".pyi"), "Go": (".go",), "Rust": (".rs",),
    "Java": (".java",), "Kotlin": (".kt", ".kts"), "Swift": (".swift",), "Ruby": (".rb",), "Elixir": (".ex", ".exs"), "PHP": (".php",),
    "C": (".c", ".h"), "C++": (".cpp", ".cc", ".hpp"), "C#": (".cs",), "Scala": (".scala",), "CSS": (".css",), "SCSS": (".scss",), "Less": (".less",),
    "HTML": (".html",), "Vue": (".vue",), "Svelte": (".svelte",), "Markdown": (".md",), "MDX": (".mdx",), "Shell": (".sh", ".bash", ".zsh"),
    "SQL": (".sql",), "YAML": (".yaml", ".yml"), "JSON": (".json",), "TOML": (".toml",),
}
NAMED_FILES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile"}
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".astro", ".cache", ".turbo", ".parcel-cache",
    "coverage", ".nyc_output", ".codemap", ".idea", ".vscode", ".gradle", "vendor",
]
SOURCE_ROOTS = ["src", "lib", "app", "apps", "packages", "cmd", "internal", "pkg", "services", "modules"]
SERVICE_MANIFESTS = [
    "package.json", "pyproject.toml", "requirements.txt", "setup.py", "Pipfile", "go.mod", "Cargo.toml", "Gemfile", "composer.json", "pom.xml",
    "build.gradle", "build.gradle.kts", "build.sbt", "mix.exs", "stack.yaml", "deno.json",
]
FRONTEND_HINTS = ["react", "react-dom", "react-native", "expo", "next", "remix", "vue", "nuxt", "@vue/", "svelte", "@sveltejs/", "astro", "@angular/", "preact", "solid-js", "qwik", "vite", "webpack"]
BACKEND_HINTS = [
    "@nestjs/", "express", "fastify", "koa", "hono", "@hapi/", "fastapi", "flask", "django", "starlette", "aiohttp", "tornado", "bottle", "sanic",
    "quart", "litestar", "github.com/gin-gonic/gin", "github.com/labstack/echo", "github.com/go-chi/chi", "github.com/gorilla/mux",
    "github.com/gofiber/fiber", "rails", "sinatra", "laravel/", "symfony/", "org.springframework.boot", "io.quarkus", "io.micronaut",
]
GRAPH_LANGUAGES = ["Python", "JavaScript", "TypeScript", "Go", "Elixir"]
ORM_STORE = {"Prisma": "postgres", "SQLAlchemy": "postgres", "Mongoose": "mongodb", "Django ORM": "postgres", "ActiveRecord": "postgres", "Spring Data JPA": "postgres"}
STORE_PATTERNS = [
    (r"\bpostgres(?:ql)?\b", "postgres", "PostgreSQL"), (r"\bmysql\b|\bmariadb\b", "mysql", "MySQL"), (r"\bredis\b", "redis", "Redis"),
    (r"\bmongo(?:db)?\b", "mongodb", "MongoDB"), (r"\belasticsearch\b|\bopensearch\b", "elasticsearch", "Elasticsearch"), (r"\bkafka\b", "kafka", "Kafka"),
    (r"\brabbitmq\b", "rabbitmq", "RabbitMQ"), (r"\bclickhouse\b", "clickhouse", "ClickHouse"), (r"\bcassandra\b", "cassandra", "Cassandra"),
    (r"\bdynamodb\b", "dynamodb", "DynamoDB"), (r"\bsqlite\b", "sqlite", "SQLite"), (r"\bs3\b|\bminio\b", "s3", "S3 / object storage"),
    (r"\bsupabase\b", "supabase", "Supabase"), (r"\bfirebase\b|\bfirestore\b", "firebase", "Firebase / Firestore"),
]
#: A route that is its own canonical form.
PLAIN_ROUTE = r"\A(?:/[0-9A-Za-z_.~%+,;=@\-]++)++\z"
#: Rewrites of route parameters to :id, in the order in which they apply.
ROUTE_PARAMETERS = [r"\$\{[^}]+\}", r"\$:[a-zA-Z_]\w*", r"\{[^/}]+\}", r"<[a-zA-Z_]+:[^/>]+>", r"<[^/>]+>", r"\[\.\.\.[^\]]+\]", r"\[[^/\]]+\]", r":\w+", r"\(\w+:[^)]+\)"]

#: Whitespace before a statement is that of its own line: with whole texts, a run of blank lines would be walked again from each of them.
PY_IMPORT = r"^[^\S\n]*+(?:from\s+(\.{0,2})([\w.]*)\s+import|import\s+([\w.]+))"
JS_IMPORT = r"""(?:\bimport\s+(?:[^"';]*?\s+from\s+)?["']([^"']+)["']|\bexport\s+[^"';]*?\s+from\s+["']([^"']+)["']|\brequire\s*\(\s*["']([^"']+)["']\s*\)|\bimport\s*\(\s*["']([^"']+)["']\s*\))"""
GO_IMPORT_SINGLE, GO_IMPORT_BLOCK, GO_IMPORT_LINE = r'^[^\S\n]*+import\s+(?:[a-zA-Z_]\w*\s+)?"([^"]+)"', r"^[^\S\n]*+import\s*\(\s*+([\s\S]*?)\)", r'(?:[a-zA-Z_]\w*\s+)?"([^"]+)"'
GO_MODULE = r"^[^\S\n]*+module\s+(\S+)"
ELIXIR_DEFMODULE, ELIXIR_MULTI_ALIAS, ELIXIR_REF = r"^[^\S\n]*+defmodule\s+([A-Z][\w.]*?)\s+do", r"^[^\S\n]*+alias\s+([A-Z][\w.]*?)\.\{([^}]*)\}", r"^[^\S\n]*+(?:alias|import|use|require)\s+([A-Z][\w.]*)"

NEST_CONTROLLER = r"@Controller\(\s*['\"`]([^'\"`]*)['\"`]"
NEST_METHOD = r"@(Get|Post|Put|Patch|Delete|All|Head|Options)\(\s*['\"`]?([^'\"`),]*)['\"`]?\s*[,)]"
JS_ROUTE = r"\b(?:app|router|server|api|route|fastify|hono|koa)\.(get|post|put|patch|delete|all|head|options|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
NEXT_EXPORT = r"\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
FASTAPI_METHOD = r"@(?:app|router|api|api_router|v1_router|v2_router|[a-zA-Z_]\w*_router)\.(get|post|put|patch|delete|head|options|websocket)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
FASTAPI_PREFIX, FASTAPI_INCLUDE = r"APIRouter\([^)]*prefix\s*=\s*['\"`]([^'\"`]+)['\"`]", r"include_router\([^)]*prefix\s*=\s*['\"`]([^'\"`]+)['\"`]"
FLASK_ROUTE = r"@(?:app|bp|blueprint|[a-zA-Z_]\w*_bp|api)\.route\(\s*['\"`]([^'\"`]+)['\"`](?:[^)]*methods\s*=\s*\[([^\]]+)\])?"
DJANGO_URL = r"\b(?:path|re_path|url)\(\s*r?['\"`]([^'\"`]+)['\"`]"
RAILS_ROUTE = r"^\s*(get|post|put|patch|delete|match|resource|resources)\s+['\":]([^'\"\s,]+)"
SPRING_MAPPING = r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"
SPRING_CONTROLLER = r"@(?:RestController|Controller)[^@]*?@RequestMapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"
LARAVEL_ROUTE = r"Route::(get|post|put|patch|delete|any|resource|apiResource)\s*\(\s*[\"']([^\"']+)[\"']"
GO_HANDLE = r"\bhttp\.HandleFunc\s*\(\s*[\"`]([^\"`]+)[\"`]"
GO_ROUTER = r"\b[a-zA-Z_]\w{0,15}\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Handle|HandleFunc)\(\s*[\"`]([^\"`]+)[\"`]"

AXIOS = r"\baxios\.(get|post|put|patch|delete|request|head|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
AXIOS_OBJECT = r"\baxios\s*\(\s*\{\s*[^}]*?url\s*:\s*['\"`]([^'\"`]+)['\"`][^}]*?\}"
FETCH = r"\bfetch\s*\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{[^}]*?method\s*:\s*['\"`](\w+)['\"`])?"
KY_GOT = r"\b(?:ky|got)\.(get|post|put|patch|delete|head|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
JQUERY = r"\$\.(get|post|ajax)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
CLIENT_OBJECT = r"\b(?:this\.\w+|\w*(?:Client|Service|Api|Http|Caller)|api|client|http)\.(get|post|put|patch|delete|request|send)\s*(?:<[^>]+>)?\s*\(\s*['\"`]([^'\"`]+)['\"`]"
BARE_VERB = r"\b(get|post|put|patch|delete|del|head)\s*(?:<[^>]+>)?\s*\(\s*[`'\"]([/][^'\"`?\s]+)[`'\"]"
BARE_IMPORT = r"^\s*import\s*\{[^}]*\b(?:get|post|put|patch|delete|del|head)\b[^}]*\}\s*from\s*['\"][\./]"
PY_REQUESTS = r"\b(?:requests|httpx|client|aiohttp_client)\.(get|post|put|patch|delete|request|head|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
PY_URLOPEN = r"\burlopen\s*\(\s*['\"`]([^'\"`]+)['\"`]"
PY_AIOHTTP = r"\b(?:session|client)\.(get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
GO_CLIENT = r"\b(?:http|client)\.(Get|Post|Head|Delete|Put|Patch|NewRequest)\s*\(\s*(?:[a-zA-Z_]\w*\s*,\s*)?[\"`]([^\"`]+)[\"`]"
RUBY_CLIENT = r"(?:Net::HTTP|HTTParty|Faraday)\.(get|post|put|patch|delete|head)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
JAVA_CLIENT = r"(?i)(?:restTemplate|webClient|httpClient)\.(get|post|put|patch|delete|exchange|getForObject|postForObject)\s*\(\s*[\"']([^\"']+)[\"']"

PRISMA_MODEL, PRISMA_SCHEMA = r"\bthis\.prisma\.(\w+)\b", r"^\s*model\s+(\w+)\s*\{"
SQLALCHEMY_CLASS, SQLALCHEMY_QUERY = r"^\s*class\s+(\w+)\s*\([^)]*\bBase\b[^)]*\)", r"\b(?:session\.query|select)\s*\(\s*(\w+)"
MONGOOSE_MODEL = r"mongoose\.model\(\s*['\"`](\w+)['\"`]"
DJANGO_MODEL, DJANGO_QUERY = r"^\s*class\s+(\w+)\s*\([^)]*\bmodels\.Model\b[^)]*\)", r"\b([A-Z]\w*)\.objects\.\w+"
ACTIVERECORD, JPA_ENTITY = r"^\s*class\s+(\w+)\s*<\s*ApplicationRecord", r"@Entity[^\w]*?(?:public\s+)?class\s+(\w+)"

MANIFESTS = {
    "package.json": "npm", "requirements.txt": "pip", "requirements.in": "pip", "pyproject.toml": "python", "Pipfile": "pipenv", "go.mod": "go",
    "Cargo.toml": "cargo", "Gemfile": "bundler", "composer.json": "composer", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle",
    "mix.exs": "hex",
}
REQUIREMENT = r"^([A-Za-z0-9_.\-]+)\s*([<>=!~][^;]*)?"
QUOTED_REQUIREMENT, PIPFILE_LINE = r'"([A-Za-z0-9_.\-]+)\s*([<>=!~][^"]*)?"', r'^([A-Za-z0-9_.\-]+)\s*=\s*"([^"]+)"'
CARGO_SECTIONS, CARGO_LINE = ["[dependencies]", "[dev-dependencies]", "[build-dependencies]"], r"^([A-Za-z0-9_\-]+)\s*=\s*(.+)$"
GEM = r"gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
MIX_DEPS, MIX_TUPLE, MIX_SOURCE = r"(?s)\bdef(?:p)?\s+deps\b.*?\bdo\b(.*?)\bend\b", r"(?s)\{\s*:([A-Za-z_]\w*)\s*,(.*?)\}", r"\b(path|github|git|branch|tag|ref|organization|hex)\s*:\s*$"
POM = r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?"
GRADLE = r"['\"]([a-zA-Z0-9_.\-]+:[a-zA-Z0-9_.\-]+):([^'\"]+)['\"]"

ENTRY_FILES = {
    "main.py": "Python main", "__main__.py": "Python module entry", "app.py": "Python app", "manage.py": "Django manage",
    "index.ts": "TypeScript module entry", "index.tsx": "TypeScript React entry", "index.js": "JavaScript module entry",
    "index.jsx": "JavaScript React entry", "index.mjs": "JavaScript ESM entry", "server.ts": "TypeScript server", "server.js": "JavaScript server",
    "main.go": "Go main", "main.rs": "Rust main", "lib.rs": "Rust library", "Cargo.toml": "Rust crate root", "Makefile": "Make build",
    "Dockerfile": "Container build", "docker-compose.yml": "Docker Compose", "docker-compose.yaml": "Docker Compose",
}
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
STORE_FILES = [".env", ".env.example", ".env.local", "config/database.yml"]
ROOT_READMES, MODULE_READMES = ["README.md", "readme.md", "README.MD", "Readme.md", "README"], ["README.md", "readme.md", "README"]
JS_BOOTSTRAPS = ["main.ts", "main.js", "index.ts", "index.js", "app.ts", "app.js", "server.ts", "server.js"]
PY_BOOTSTRAPS = ["main.py", "app.py", "asgi.py", "wsgi.py", "__main__.py"]
NEST_PREFIX, EXPRESS_PREFIX = r"\bsetGlobalPrefix\s*\(\s*['\"`]([^'\"`]+)['\"`]", r"\bapp\.use\s*\(\s*['\"`](/[a-zA-Z0-9/_\-]+)['\"`]"
APP_PREFIX = r"\binclude_router\s*\([^)]*prefix\s*=\s*['\"`]([^'\"`]+)['\"`]"
HEADING = r"^(#{1,3})\s+(.+)$"
NOT_PROSE = r"^#|\[!\[|^\[[^\]]+\]:\s*\S+|^<[^>]+>|^<!--|^!\["
PROSE_NOISE = [r"https?://\S+", r"!?\[[^\]]*\]\([^)]*\)", r"!?\[[^\]]*\]\[[^\]]*\]"]
UTILITY_MODULES = ["common", "shared", "utils", "util", "prisma", "db", "lib", "core", "types", "helpers", "models", "schemas"]
FLOW_CONFIDENCE = ["high", "medium", "low"]
FLOW_KINDS = ["bootstrap", "request", "scheduled", "background", "state-machine", "pipeline"]
METHOD_ORDER = ["GET", "POST", "PUT", "PATCH", "DELETE", "ANY", "HEAD", "OPTIONS"]
#: For each depth: levels of the tree, module cards, modules in the graph, packages of an ecosystem; None is all.
DEPTH_TIERS = {
    "shallow": {"tree": 2, "cards": 10, "graph": 30, "packages": 20},
    "medium": {"tree": 4, "cards": 25, "graph": 80, "packages": 40},
    "full": {"tree": None, "cards": None, "graph": None, "packages": None},
}
EVIDENCE_READMES = ["README.md", "readme.md", "README"]
EVIDENCE_MANIFESTS = [
    "package.json", "mix.exs", "go.mod", "pyproject.toml", "requirements.txt", "docker-compose.yml", "compose.yml", ".env.example", "Gemfile",
    "pom.xml", "build.gradle", "Cargo.toml", "composer.json",
]
ROUTE_FILES = r"(router\.(ex|rb|ts|js)|urls\.py|routes\.rb|schema\.(ex|prisma|graphql|ts)|\.graphql$|route\.(ts|js)$)"
ARCHITECTURE_DOCS = r"(?i)(ARCHITECTURE|CODEBASE_MAP)"
MAIN_FILES = r"^(index|main)\.(ts|tsx|js|jsx|py|go|rb|ex)$"
