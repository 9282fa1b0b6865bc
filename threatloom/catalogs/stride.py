"""STRIDE-LM catalogue."""

# Category codes in catalogue order (the order also breaks score ties).
CODES = ["S", "T", "R", "I", "D", "E", "L", "M"]

# Full names.
FULL_NAMES = {
    "S": "Spoofing",
    "T": "Tampering",
    "R": "Repudiation",
    "I": "Information Disclosure",
    "D": "Denial of Service",
    "E": "Elevation of Privilege",
    "L": "Lateral Movement",
    "M": "Malware",
}

# Guiding questions.
QUESTIONS = {
    "S": "Who are you, really?",
    "T": "Can I trust what I'm seeing?",
    "R": "Did that really happen?",
    "I": "What's escaping?",
    "D": "Can you still operate?",
    "E": "What can they reach now?",
    "L": "Where are they going next?",
    "M": "What did they leave behind?",
}

# Keywords, matched as whole words without case.
KEYWORDS = {
    "S": ["authentication", "credential", "identity", "token", "session", "phishing", "impersonation",
          "auth bypass", "spoofing", "forgery", "oauth", "saml", "jwt", "password", "login", "username"],
    "T": ["injection", "tampering", "modification", "supply chain", "mitm", "integrity", "sql injection",
          "xss", "csrf", "code injection", "path traversal", "file upload", "deserialization", "backdoor"],
    "R": ["logging", "audit", "repudiation", "forensics", "timestamp", "log injection", "audit bypass",
          "accountability", "traceability"],
    "I": ["disclosure", "exposure", "leak", "breach", "exfiltration", "information disclosure",
          "sensitive data", "confidentiality", "privacy", "secrets", "credentials", "pii",
          "directory traversal"],
    "D": ["dos", "ddos", "denial of service", "resource exhaustion", "amplification", "flood", "cpu",
          "memory", "regex", "algorithmic complexity"],
    "E": ["privilege escalation", "elevation", "privesc", "root", "admin", "sudo", "setuid",
          "capabilities", "authorization", "access control"],
    "L": ["lateral movement", "pivoting", "network traversal", "smb", "rdp", "pass the hash",
          "credential reuse", "east-west", "internal network"],
    "M": ["malware", "trojan", "backdoor", "c2", "command and control", "ransomware", "rootkit",
          "persistence", "implant", "remote access", "cryptominer", "botnet", "rat", "apt"],
}

# Weakness ids per category.
CWE_IDS = {
    "S": [287, 290, 294, 295, 306, 307, 346, 384, 522, 798],
    "T": [20, 74, 78, 79, 89, 94, 352, 502, 611, 913],
    "R": [117, 532, 778],
    "I": [22, 200, 209, 215, 312, 319, 326, 327, 359, 532, 538],
    "D": [400, 404, 770, 776, 834, 835],
    "E": [269, 274, 277, 278, 282, 283, 284, 285, 862, 863],
    "L": [653],
    "M": [506, 912],
}

# Tactic id to category.
TACTICS = {
    "TA0001": "S", "TA0002": "M", "TA0003": "M", "TA0004": "E", "TA0005": "T", "TA0006": "S",
    "TA0007": "L", "TA0008": "L", "TA0009": "I", "TA0010": "I", "TA0011": "M", "TA0040": "D",
}

# The detection rules written by enrichment; only Spoofing has any.
ENRICHMENT_RULES = {
    "S": ["Monitor authentication failures", "Track credential usage patterns", "Validate token integrity"],
}

# Mitigation strategies.
MITIGATION = {
    "S": ["Implement MFA across all systems", "Use hardware security keys where possible",
          "Enforce certificate-based authentication", "Implement passwordless authentication"],
    "T": ["Sign all code and data", "Implement software bill of materials (SBOM)",
          "Use secure channels for all transfers", "Deploy runtime integrity monitoring"],
    "R": ["Use write-once logging systems", "Implement centralized SIEM",
          "Enable audit logs for all critical systems", "Use blockchain for critical audit trails"],
    "I": ["Encrypt data at rest and in transit", "Implement secrets management systems",
          "Use data classification and DLP", "Regular access reviews and least privilege"],
    "D": ["Implement rate limiting and backpressure", "Use CDN and DDoS protection",
          "Design for graceful degradation", "Implement circuit breakers"],
    "E": ["Enforce principle of least privilege", "Use just-in-time access provisioning",
          "Implement privilege access management", "Regular privilege audits and reviews"],
    "L": ["Implement network segmentation", "Use zero-trust architecture",
          "Enforce explicit trust verification", "Monitor and restrict east-west traffic"],
    "M": ["Deploy EDR/XDR solutions", "Implement application whitelisting",
          "Use behavioral analysis and sandboxing", "Regular threat hunting exercises"],
}

# Asset types that a category touches.
ASSET_TYPES = {
    "S": ["authentication", "session"],
    "T": ["database", "filesystem"],
    "R": [],
    "I": ["database", "api", "secret"],
    "D": ["api", "network"],
    "E": ["authentication"],
    "L": ["network", "api"],
    "M": [],
}

# Category to ATT&CK technique, weight and reason, in listing order.
TECHNIQUES = {
    "S": [("T1078", 0.9, "Spoofing often involves using valid credentials"),
          ("T1110", 0.7, "Credential attacks may involve brute force"),
          ("T1566", 0.8, "Phishing is a common spoofing technique")],
    "T": [("T1565", 0.9, "Tampering involves data manipulation"),
          ("T1190", 0.7, "Exploitation often leads to tampering"),
          ("T1027", 0.6, "Tampering may involve obfuscation")],
    "R": [("T1070", 0.95, "Repudiation involves removing evidence"),
          ("T1562", 0.7, "May disable logging or monitoring")],
    "I": [("T1005", 0.8, "Information disclosure involves data collection"),
          ("T1041", 0.7, "Data may be exfiltrated"),
          ("T1567", 0.7, "Data may be exfiltrated via web services"),
          ("T1083", 0.6, "May involve discovering sensitive files")],
    "D": [("T1499", 0.95, "Direct DoS attack"),
          ("T1490", 0.6, "May prevent recovery from DoS")],
    "E": [("T1068", 0.9, "Elevation involves privilege escalation"),
          ("T1078", 0.7, "May use valid accounts with elevated privileges")],
    "L": [("T1021", 0.9, "Lateral movement via remote services"),
          ("T1550", 0.8, "May use tokens for lateral movement"),
          ("T1087", 0.6, "Discovery before lateral movement")],
    "M": [("T1059", 0.8, "Malware execution via scripting"),
          ("T1543", 0.8, "Malware persistence"),
          ("T1071", 0.7, "Malware C2 communication"),
          ("T1105", 0.7, "Malware delivery")],
}
