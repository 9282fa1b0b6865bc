"""Architecture types, their signals and what they change in a threat model."""

# Type codes in catalogue order (the order also breaks vote ties) and display names.
NAMES = {
    "monolith": "Monolith", "microservices": "Microservices", "serverless": "Serverless", "cli": "CLI Tool",
    "library": "Library/SDK", "api-service": "API Service", "web-app": "Web Application",
    "mobile-backend": "Mobile Backend", "data-pipeline": "Data Pipeline", "ai-ml": "AI/ML Service",
    "unknown": "Unknown",
}

# Marker files per language, in the order languages are tested.
LANGUAGE_MARKERS = {
    "go": ["go.mod", "go.sum", "main.go"],
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile"],
    "javascript": ["package.json", "node_modules"],
    "typescript": ["tsconfig.json", "package.json"],
    "java": ["pom.xml", "build.gradle", "gradle.properties"],
    "ruby": ["Gemfile", "Rakefile"],
    "rust": ["Cargo.toml", "Cargo.lock"],
    "php": ["composer.json", "composer.lock"],
}

# Manifest files per language, in fallback order.
MANIFESTS = {
    "go": ["go.mod"], "python": ["requirements.txt", "Pipfile"], "javascript": ["package.json"],
    "typescript": ["package.json"], "ruby": ["Gemfile"], "java": ["pom.xml", "build.gradle"],
    "rust": ["Cargo.toml"],
}

# Manifest whose text votes for an architecture, in fallback order.
SIGNAL_MANIFESTS = {
    "go": ["go.mod"], "python": ["requirements.txt", "Pipfile", "pyproject.toml"],
    "javascript": ["package.json"], "typescript": ["package.json"], "java": ["pom.xml", "build.gradle"],
    "ruby": ["Gemfile"], "rust": ["Cargo.toml"],
}

# Framework tests per language: manifest, then (text, framework) in order, then default.
FRAMEWORK_TESTS = {
    "go": ("go.mod", [("gin-gonic/gin", "gin"), ("labstack/echo", "echo"), ("gorilla/mux", "gorilla"),
                      ("fiber", "fiber")], "stdlib"),
    "python": ("requirements.txt", [("django", "django"), ("flask", "flask"), ("fastapi", "fastapi")],
               "unknown"),
    "javascript": ("package.json", [('"react"', "react"), ('"express"', "express"), ('"next"', "nextjs"),
                                    ('"vue"', "vue")], "unknown"),
    "typescript": ("package.json", [('"react"', "react"), ('"express"', "express"), ('"next"', "nextjs"),
                                    ('"vue"', "vue")], "unknown"),
}

# Web frameworks and the texts that mark them; the four page frameworks vote for web-app.
WEB_FRAMEWORKS = {
    "express": ["express", "expressjs"], "fastapi": ["fastapi"], "flask": ["flask"], "django": ["django"],
    "gin": ["gin-gonic", "gin"], "echo": ["labstack/echo"], "fiber": ["gofiber", "fiber"],
    "rails": ["rails"], "spring": ["spring-boot", "springframework"], "nextjs": ["next"],
    "react": ["react"], "vue": ["vue"], "angular": ["angular", "@angular"],
}
PAGE_FRAMEWORKS = ["nextjs", "react", "vue", "angular"]

# Dependency groups; the first text that occurs is the evidence.
SERVERLESS_DEPS = ["aws-lambda", "lambda", "azure-functions", "google-cloud-functions", "serverless",
                   "chalice", "zappa", "claudia", "apex"]
QUEUE_DEPS = ["kafka", "rabbitmq", "amqp", "nats", "redis", "celery", "bull", "sidekiq"]
ML_DEPS = ["tensorflow", "torch", "pytorch", "transformers", "langchain", "openai", "anthropic",
           "huggingface", "scikit-learn", "sklearn", "keras", "jax", "lightgbm", "xgboost", "mlflow"]
DATA_DEPS = ["apache-airflow", "airflow", "prefect", "dagster", "spark", "pyspark", "hadoop", "dask",
             "pandas"]
MOBILE_DEPS = ["firebase", "fcm", "apns", "push-notifications", "expo", "react-native", "flutter"]
CLI_DEPS = ["cobra", "click", "argparse", "clap", "commander", "yargs", "oclif"]
CLI_BLOCKERS = ["http", "express", "gin", "fastapi"]

# Directory groups of the project structure.
FRONTEND_DIRS = ["frontend", "client", "web", "ui", "public"]
DATA_DIRS = ["pipelines", "etl", "dags", "airflow"]
ML_DIRS = ["models", "training", "notebooks", "data"]
SERVERLESS_FILES = ["serverless.yml", "serverless.yaml", "template.yaml", "template.yml", "firebase.json"]
TERRAFORM_FUNCTIONS = ["aws_lambda", "google_cloudfunctions", "azurerm_function_app"]

# Entry files per language and the texts looked for in them.
MAIN_FILES = {
    "go": ["main.go", "cmd/main.go"],
    "python": ["main.py", "app.py", "__main__.py"],
    "javascript": ["index.js", "index.ts", "server.js", "app.js"],
    "typescript": ["index.js", "index.ts", "server.js", "app.js"],
}
HTTP_TEXTS = ["http.listenandserve", "app.listen", "server.listen", "uvicorn.run", "app.run", "serve("]
CLI_TEXTS = ["flag.parse", "argparse", "click.command", "cobra.command", "clap.app", "args.parse"]

# Per type, extra threats, risk multipliers by category name, recommendations, controls.
ADJUSTMENTS = {
    "microservices": (
        ["Service-to-service authentication bypass", "API gateway misconfiguration",
         "Service mesh security gaps", "East-west traffic interception",
         "Distributed tracing data exposure", "Service discovery poisoning",
         "Circuit breaker manipulation", "Cascading failures from single service compromise"],
        {"Tampering": 1.3, "Elevation of Privilege": 1.2},
        ["Implement mutual TLS (mTLS) for service-to-service communication",
         "Use service mesh with zero-trust policies",
         "Enforce API gateway authentication and rate limiting",
         "Implement distributed tracing with sensitive data redaction",
         "Monitor east-west traffic for anomalies",
         "Use network policies to restrict inter-service communication"],
        ["Service Mesh (Istio, Linkerd, Consul)", "API Gateway (Kong, Ambassador, Envoy)",
         "Distributed Tracing (Jaeger, Zipkin)", "Service Registry (Consul, Eureka)",
         "Secrets Management (Vault, Sealed Secrets)"]),
    "serverless": (
        ["Cold start injection attacks", "Event injection and manipulation", "Over-permissive IAM roles",
         "Function timeout exploitation", "Shared execution environment escape",
         "Function poisoning via dependencies", "Secrets exposure in environment variables",
         "Denial of wallet (resource exhaustion)"],
        {"Spoofing": 1.4, "Elevation of Privilege": 1.5},
        ["Apply principle of least privilege to IAM roles", "Validate all event sources and payloads",
         "Use secrets manager instead of environment variables", "Implement function-level access controls",
         "Monitor function invocation patterns for anomalies",
         "Set aggressive timeout and memory limits", "Use VPC for sensitive functions"],
        ["IAM Policy Analyzer", "Function-level firewalls", "Secrets Manager integration",
         "CloudWatch/CloudTrail monitoring", "VPC isolation for sensitive functions"]),
    "monolith": (
        ["Single point of failure - full system compromise", "Large blast radius from any vulnerability",
         "Privilege escalation within monolith", "Shared database access from all code paths",
         "Difficult to implement least privilege", "Session hijacking affects entire application"],
        {"Information Disclosure": 1.2, "Denial of Service": 1.3},
        ["Implement strong internal access controls", "Use principle of least privilege at database level",
         "Deploy behind load balancer with health checks",
         "Implement comprehensive logging and monitoring",
         "Consider modular architecture for future decomposition",
         "Use feature flags to limit blast radius"],
        []),
    "cli": (
        ["Command injection via arguments", "Path traversal in file operations",
         "Credential theft from config files", "Environment variable manipulation",
         "Binary tampering and supply chain attacks", "Insecure update mechanisms"],
        {"Tampering": 1.2, "Elevation of Privilege": 1.1},
        ["Validate and sanitize all command-line inputs", "Use absolute paths and avoid shell execution",
         "Store credentials in OS-provided secure storage",
         "Sign binaries and verify signatures on updates",
         "Implement secure auto-update with verification", "Minimize required privileges"],
        []),
    "library": (
        ["Supply chain attacks via dependency", "API misuse by downstream consumers",
         "Transitive dependency vulnerabilities", "Namespace/typosquatting attacks",
         "Version confusion attacks", "Insecure defaults propagated to consumers"],
        {"Tampering": 1.4},
        ["Implement secure defaults and fail-safe APIs", "Provide clear security documentation",
         "Minimize dependencies and audit transitive deps", "Use dependency pinning and lock files",
         "Sign published packages", "Implement semver strictly and communicate breaking changes"],
        []),
    "api-service": (
        ["API authentication bypass", "Broken object-level authorization (BOLA)",
         "Mass assignment vulnerabilities", "API rate limiting bypass",
         "GraphQL query complexity attacks", "API versioning vulnerabilities", "CORS misconfiguration"],
        {"Spoofing": 1.3, "Information Disclosure": 1.2},
        ["Implement OAuth 2.0 or API key authentication", "Enforce object-level authorization checks",
         "Use allow-lists for API input fields", "Implement rate limiting per user/IP",
         "Validate and limit query complexity", "Use API gateway for centralized security"],
        []),
    "web-app": (
        ["Cross-site scripting (XSS)", "Cross-site request forgery (CSRF)", "Clickjacking",
         "Open redirects", "Server-side template injection", "Frontend secrets exposure",
         "Client-side storage attacks"],
        {"Spoofing": 1.2, "Tampering": 1.2},
        ["Implement Content Security Policy (CSP)", "Use CSRF tokens for state-changing operations",
         "Set X-Frame-Options and HTTPS headers", "Sanitize all user input before rendering",
         "Never store secrets in frontend code", "Use HTTP-only and Secure flags on cookies"],
        []),
    "mobile-backend": (
        ["Mobile app reverse engineering", "API key extraction from mobile apps",
         "Push notification injection", "Device token theft", "Certificate pinning bypass",
         "Jailbreak/root detection bypass", "Deep link hijacking"],
        {"Spoofing": 1.3, "Information Disclosure": 1.2},
        ["Implement certificate pinning in mobile app", "Use device attestation APIs",
         "Validate push notification recipients", "Implement rate limiting per device",
         "Use backend-driven feature flags", "Monitor for rooted/jailbroken devices"],
        []),
    "data-pipeline": (
        ["Data poisoning attacks", "Pipeline injection", "ETL logic bypass",
         "Unauthorized data access during processing", "Data exfiltration via pipeline logs",
         "Schema manipulation attacks", "Workflow orchestration tampering"],
        {"Tampering": 1.4, "Information Disclosure": 1.3},
        ["Validate and sanitize all input data", "Implement data lineage tracking",
         "Encrypt data at rest and in transit", "Use least privilege for pipeline service accounts",
         "Implement data quality checks and alerts", "Restrict access to pipeline orchestration"],
        []),
    "ai-ml": (
        ["Prompt injection attacks", "Model inversion and extraction", "Training data poisoning",
         "Adversarial input attacks", "Model backdoors", "Sensitive data leakage from training data",
         "RAG context injection", "LLM jailbreaking"],
        {"Information Disclosure": 1.5, "Tampering": 1.3},
        ["Implement MAESTRO layer security controls", "Validate and sanitize all prompts and inputs",
         "Use content filtering and output validation", "Implement rate limiting on model inference",
         "Monitor for adversarial patterns", "Sanitize training data and implement differential privacy",
         "Use guardrails for LLM outputs"],
        ["Prompt injection filters", "Output content filtering", "Model access controls",
         "Differential privacy", "Adversarial robustness testing"]),
}

# The line a secondary type adds when it is not the primary type.
SECONDARY_THREATS = {
    "ai-ml": "ML model security - see AI/ML architecture threats",
    "data-pipeline": "Data pipeline security - validate data flows",
}
