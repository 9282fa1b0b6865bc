"""What the line scanner, the code rules and the flow kinds look for."""

# Source-file suffixes that are scanned.
CODE_SUFFIXES = ["go", "py", "js", "ts", "java", "rb", "php", "rs", "c", "cpp", "h"]

# Asset families in scan order, with the texts of which the first to occur (without
# case) marks the line.
PATTERNS = {
    "api": ["http.HandleFunc", "http.Handle", "mux.HandleFunc", "router.GET", "router.POST", "router.PUT",
            "router.DELETE", "router.PATCH", ".GET(", ".POST(", ".PUT(", ".DELETE(", ".PATCH(", "app.get",
            "app.post", "app.put", "app.delete", "app.patch", "@app.route", "@router", "@GetMapping",
            "@PostMapping", "@PutMapping", "@DeleteMapping", "@RequestMapping", "Route(", "MapGet",
            "MapPost", "express.get", "express.post", "fastapi", "flask.route"],
    "db": ["db.Query", "db.Exec", "db.Prepare", "database/sql", "sqlx.", "gorm", ".Create(", ".Save(",
           ".Update(", ".Delete(", "mongoose.connect", "mongoose.model", "Schema(", "pg.connect",
           "psycopg2", "pymongo", "redis.client", "SELECT ", "INSERT ", "UPDATE ", "DELETE FROM",
           "CREATE TABLE", "DROP TABLE", "ALTER TABLE", "TRUNCATE", "sql.Open", "sql.DB", "Sequelize",
           "TypeORM"],
    "auth": ["jwt.sign", "jwt.verify", "jsonwebtoken", "passport", "bcrypt", "scrypt", "argon2", "pbkdf2",
             "OAuth", "oauth2", "openid", "saml", ".Authenticate", "CheckPassword", "ValidateToken",
             "middleware.Auth", "@RequiresAuth", "@Secured", "session.set", "session.get",
             "express-session", ".login", ".logout", ".signin", ".signout"],
    "file": ["os.Open", "os.Create", "os.ReadFile", "os.WriteFile", "ioutil.ReadFile", "ioutil.WriteFile",
             "fs.readFile", "fs.writeFile", "fs.createReadStream", "open(", "file.open", "with open",
             "FileReader", "FileWriter", "BufferedReader", "upload", "multipart", "formidable"],
    "extapi": ["http.Get", "http.Post", "http.Client", "fetch(", "axios.", "request(", "requests.get",
               "requests.post", "urllib", "HttpClient", "RestTemplate", "WebClient", "curl_exec",
               "curl_init"],
    "env": ["os.Getenv", "process.env", "System.getenv", "ENV[", "ENV.fetch", "$ENV{", "dotenv", "envfile",
            ".env"],
    "secret": ["api_key", "apikey", "api-key", "secret", "password", "passwd", "pwd", "private_key",
               "privatekey", "token", "credentials", "auth_token", "access_key", "client_secret",
               "encryption_key"],
    "queue": ["kafka", "rabbitmq", "amqp", "redis.publish", "redis.subscribe", "sqs", "sns", "pubsub",
              "messagequeue", "eventbus"],
    "cache": ["redis", "memcached", "cache.set", "cache.get", "@Cacheable", "CacheManager"],
    "crypto": ["crypto/", "cryptography", "cipher", "aes", "rsa", "ecdsa", "hmac", "encrypt", "decrypt",
               "hash"],
}

# Family to asset type, description prefix and tags.
FAMILIES = {
    "api": ("api", "HTTP endpoint: ", ["http", "endpoint", "api"]),
    "db": ("database", "Database operation: ", ["database", "sql", "persistence"]),
    "auth": ("authentication", "Authentication: ", ["auth", "security", "identity"]),
    "file": ("filesystem", "File I/O: ", ["file", "io", "storage"]),
    "extapi": ("network", "External call: ", ["external", "api", "network"]),
    "env": ("secret", "Environment variable: ", ["config", "environment", "secret"]),
    "secret": ("secret", "Potential secret: ", ["secret", "credential", "sensitive"]),
    "queue": ("queue", "Queue operation: ", ["queue", "messaging", "async"]),
    "cache": ("cache", None, ["cache", "performance"]),
    "crypto": ("cryptography", "Crypto: ", ["crypto", "security", "encryption"]),
}

# Words that make a line sensitive.
SENSITIVE_WORDS = ["password", "secret", "token", "key", "credential", "auth", "payment", "credit", "ssn",
                   "personal"]

# Flow kinds in analysis order: kind, source type, destination type, data type, threats.
# "*" is any non-secret type, "+" any sensitive type other than cryptography.
FLOW_KINDS = [
    ("api-db", "api", "database", "user_data", ["SQL Injection", "Data Tampering"]),
    ("api-ext", "api", "network", "forwarded_request", ["SSRF", "Data Leakage"]),
    ("auth-api", "authentication", "api", "authenticated_request",
     ["Broken Authentication", "Session Hijacking"]),
    ("api-file", "api", "filesystem", "file_upload", ["Path Traversal", "Arbitrary File Upload"]),
    ("env-svc", "secret", "*", "configuration", ["Secret Exposure", "Configuration Tampering"]),
    ("db-cache", "database", "cache", "cached_data", ["Cache Poisoning", "Data Exposure"]),
    ("api-queue", "api", "queue", "async_message", ["Message Injection", "Replay Attacks"]),
    ("data-crypto", "+", "cryptography", "encrypted_data", ["Weak Cryptography", "Key Management"]),
]

# Code rules: number, title, severity, STRIDE categories, recommendations.
RULES = {
    1: ("Unauthenticated API Endpoint", "high", ["S", "E"], [
        "Implement authentication middleware for all API endpoints",
        "Verify authorization checks are in place before processing requests",
        "Use framework-provided authentication guards or decorators",
        "Review access control policies for this endpoint"]),
    2: ("Potential SQL Injection", "critical", ["T", "I"], [
        "CRITICAL: Use parameterized queries or prepared statements",
        "Never concatenate user input into SQL queries",
        "Use an ORM with built-in SQL injection protection",
        "Validate and sanitize all inputs before database operations"]),
    3: ("Hardcoded Credential Detected", "critical", ["I"], [
        "CRITICAL: Remove hardcoded credentials immediately",
        "Use environment variables or secure secret management",
        "Rotate all exposed credentials",
        "Implement secret scanning in CI/CD pipeline",
        "Consider using HashiCorp Vault, AWS Secrets Manager, or similar"]),
    4: ("Insecure External API Call", "medium", ["T"], [
        "Enable TLS/SSL certificate verification",
        "Use HTTPS for all external API calls",
        "Implement certificate pinning for critical services",
        "Reject connections with invalid certificates"]),
    5: ("Path Traversal Risk", "high", ["T", "I"], [
        "Validate and sanitize all file paths from user input",
        "Use allowlist of permitted directories",
        "Resolve paths and check they stay within allowed boundaries",
        "Use framework-provided safe file handling APIs"]),
    6: ("Cryptographic Error Leakage", "medium", ["I"], [
        "Implement proper error handling for cryptographic operations",
        "Avoid leaking detailed error messages to users",
        "Use constant-time comparison for sensitive operations",
        "Log crypto failures securely without exposing details"]),
    7: ("Insecure Token Storage", "high", ["S"], [
        "Store tokens in secure, httpOnly cookies",
        "Use secure session management libraries",
        "Implement token expiration and rotation",
        "Never store tokens in localStorage without encryption"]),
    8: ("Sensitive Data Exposure", "high", ["I"], [
        "Encrypt sensitive data before external transmission",
        "Minimize data exposure - only send what's necessary",
        "Implement data loss prevention (DLP) controls",
        "Review and log all external data transmissions"]),
    9: ("Unvalidated Trust Boundary Crossing", "medium", ["T"], [
        "Validate all data crossing trust boundaries",
        "Implement input validation and sanitization",
        "Use schema validation for structured data",
        "Apply principle of least privilege to data access"]),
    10: ("Authentication Data in Cleartext", "high", ["S"], [
        "URGENT: Use TLS/HTTPS for all authentication flows",
        "Never transmit credentials over unencrypted connections",
        "Implement end-to-end encryption for sensitive auth data",
        "Use secure authentication protocols (OAuth2, SAML, etc.)"]),
    11: ("LLM Integration - Prompt Injection Risk", "high", ["T", "E"], [
        "Implement prompt injection detection and filtering",
        "Use structured outputs and validation",
        "Separate system prompts from user inputs",
        "Apply MAESTRO Layer 1 (Foundation Model) security controls",
        "Monitor and log all LLM interactions for anomalies"]),
    12: ("Dynamic Tool Loading - Tool Poisoning Risk", "high", ["T", "E"], [
        "Validate and sanitize all tool definitions",
        "Use allowlist for permitted tools and functions",
        "Implement tool execution sandboxing",
        "Apply MAESTRO Layer 4 (Tooling) security controls",
        "Monitor tool invocations for suspicious patterns"]),
    13: ("Inter-Agent Communication - Authentication Risk", "medium", ["S", "T"], [
        "Implement mutual TLS (mTLS) for service-to-service communication",
        "Use service mesh for authentication and authorization",
        "Validate all inter-agent messages",
        "Apply MAESTRO Layer 5 (Agent Communication) security controls",
        "Implement message signing and verification"]),
}

# Description templates of the rules; asset rules use name/file/line.
RULE_TEXTS = {
    1: "API endpoint '{name}' at {file}:{line} may lack authentication checks",
    2: "Database operation at {file}:{line} may be vulnerable to SQL injection due to string concatenation",
    3: "Hardcoded credential found: {name} at {file}:{line}",
    4: "External API call at {file}:{line} may lack TLS verification",
    5: "File operation at {file}:{line} may be vulnerable to path traversal",
    6: "Cryptographic operation at {file}:{line} may leak errors or timing information",
    7: "Auth token at {file}:{line} may be stored insecurely",
    8: "Sensitive data flows from {src} to external endpoint {dst}",
    9: "Data crosses trust boundary from {src} to {dst} without apparent validation",
    10: "Authentication data may traverse unencrypted channel from {src} to {dst}",
    11: "LLM/AI framework detected at {file}:{line} - susceptible to prompt injection attacks",
    12: "Dynamic tool/plugin loading detected at {file}:{line} - risk of tool poisoning",
    13: "Inter-service communication detected at {file}:{line} - may lack mutual authentication",
}

# Words of the asset-rule predicates.
CONCAT_WORDS = ["+", "concat", "sprintf", "format", 'f"', "${", "interpolat"]
INSECURE_STORAGE_WORDS = ["localstorage", "sessionstorage", "cookie", "plaintext"]

# Agentic rules: words, whether the file name counts too, extra tags.
AGENTIC_RULES = {
    11: (["openai", "anthropic", "langchain", "llama", "gpt", "claude", "bedrock"], True,
         ["MAESTRO", "AI", "LLM", "prompt-injection"]),
    12: (["plugin", "tool", "function_calling", "tooling"], False, ["MAESTRO", "tooling", "plugins"]),
    13: (["grpc", "graphql", "websocket", "microservice"], False,
         ["MAESTRO", "microservices", "agent-comm"]),
}

# Words that link an asset to a threat; the list position is the bit number.
LINK_WORDS = ["api", "database", "auth", "secret", "credential"]

# Regex rules over source lines: id, pattern, severity, weakness, sub-requirement.
REGEX_RULES = [
    ("pci-pan-hardcoded", "(?:^|[^0-9])([0-9]{13,19})(?:[^0-9]|$)", "ERROR", "CWE-312", "3.5.1"),
    ("pci-cvv-logging", "(?i)(cvv|cvc|cid|cav|card.?verification)", "ERROR", "CWE-532", "3.3.3"),
    ("pci-track-data-logging", "(?i)(track.?data|magnetic.?stripe|full.?track)", "ERROR", "CWE-532", "3.3.2"),
    ("pci-pin-storage", "(?i)(pin|personal.?identification.?number)", "ERROR", "CWE-312", "3.3.1"),
    ("pci-cardholder-overcollection", "(?i)(card|payment|transaction|customer|account)", "WARNING", "", "3.2.1"),
    ("pci-sensitive-endpoint", "(api|admin|account|payment|card|transaction)", "ERROR", "CWE-306", "8.3.1"),
    ("pci-sensitive-data-in-logs",
     "(?i)(password|pwd|pass|secret|token|api.?key|cvv|pin|card.?number|pan)", "ERROR", "CWE-532", "3.3.1"),
    ("pci-log-tampering", "(?i)(log|audit)", "ERROR", "CWE-778", "10.2.1.3"),
]

# Asset type to diagram node type; every other type is a service.
NODE_TYPES = {"api": "api", "database": "database", "secret": "external", "network": "external",
              "session": "cache", "cache": "cache", "queue": "queue"}

# Node label heads by asset type.
NODE_LABELS = {
    "api": "API Endpoints", "database": "Database Operations", "authentication": "Authentication",
    "secret": "Secrets/Config", "filesystem": "File Operations", "network": "External APIs",
    "cache": "Cache", "queue": "Message Queue", "cryptography": "Cryptography",
}

# Label words of crown jewels, and label words that raise a jewel's value.
JEWEL_WORDS = ["secret", "credential", "password", "key", "vault", "admin", "auth"]
VALUE_WORDS = ["secret", "credential", "password", "vault", "admin", "payment", "pii"]

# Example fixes by category for Go code.
FIX_DEFAULT = "// Implement appropriate security control"
FIX_SPOOFING_GO = """// Add authentication middleware
func AuthMiddleware(next http.Handler) http.Handler {
    return http.HandlerFunc(func(w http.ResponseWriter, r *http.Request) {
        token := r.Header.Get("Authorization")
        if !validateToken(token) {
            http.Error(w, "Unauthorized", http.StatusUnauthorized)
            return
        }
        next.ServeHTTP(w, r)
    })
}"""
FIX_TAMPERING_GO_DATABASE = """// Use parameterized queries
stmt, err := db.Prepare("SELECT * FROM users WHERE id = ?")
if err != nil {
    return err
}
defer stmt.Close()
rows, err := stmt.Query(userID)  // Safe from SQL injection"""
FIX_DISCLOSURE_GO = """// Add encryption for sensitive data
encrypted, err := encryptData(sensitiveData)
if err != nil {
    return err
}
// Store encrypted data
db.Exec("INSERT INTO secrets (data) VALUES (?)", encrypted)"""
