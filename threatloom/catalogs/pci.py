"""PCI DSS v4.0 requirements and how threats map to them."""

# Requirement id, title, category.
REQUIREMENTS = [
    ("1", "Install and Maintain Network Security Controls", "Network Security"),
    ("2", "Apply Secure Configurations to All System Components", "Secure Configuration"),
    ("3", "Protect Stored Account Data", "Data Protection"),
    ("4", "Protect Cardholder Data with Strong Cryptography During Transmission", "Encryption in Transit"),
    ("5", "Protect All Systems and Networks from Malicious Software", "Malware Protection"),
    ("6", "Develop and Maintain Secure Systems and Software", "Secure Development"),
    ("7", "Restrict Access to System Components and Cardholder Data by Business Need to Know", "Access Control"),
    ("8", "Identify Users and Authenticate Access to System Components", "Authentication"),
    ("9", "Restrict Physical Access to Cardholder Data", "Physical Security"),
    ("10", "Log and Monitor All Access to System Components and Cardholder Data", "Logging"),
    ("11", "Test Security of Systems and Networks Regularly", "Security Testing"),
    ("12", "Support Information Security with Organizational Policies and Programs", "Policy"),
]

# Sub-requirement id, its text, and whether code analysis can tell about it.
SUB_REQUIREMENTS = [
    ("1.2.7", "Configuration files for network security controls are secured from unauthorized access", True),
    ("1.4.2", "Inbound traffic from untrusted networks to trusted networks is restricted", True),
    ("2.2.2", "Vendor default accounts are managed", True),
    ("2.2.4", "Only necessary services, protocols, and ports are enabled", True),
    ("2.2.7", "All non-console administrative access is encrypted using strong cryptography", True),
    ("3.2.1", "Account data storage is kept to a minimum through implementation of data retention and disposal policies", True),
    ("3.3.1", "Sensitive authentication data (SAD) is not retained after authorization", True),
    ("3.3.2", "Sensitive authentication data is not stored after authorization, even if encrypted", True),
    ("3.3.3", "The card verification code (CAV2/CVC2/CVV2/CID) is not stored after authorization", True),
    ("3.5.1", "Primary account number (PAN) is secured wherever it is stored", True),
    ("3.6.1", "Procedures for protecting cryptographic keys are defined and implemented", True),
    ("3.7.1", "Access to cleartext cryptographic key components is restricted to the fewest number of custodians necessary", True),
    ("4.2.1", "Strong cryptography and security protocols are implemented to safeguard PAN during transmission", True),
    ("4.2.1.1", "An inventory of trusted keys and certificates is maintained", True),
    ("4.2.1.2", "Wireless networks transmitting cardholder data or connected to the CDE use strong cryptography", True),
    ("5.2.1", "Anti-malware mechanisms are configured to perform periodic scans and active/real-time scans", False),
    ("5.3.2", "Anti-malware mechanisms and definitions are kept current", False),
    ("6.2.2", "Bespoke and custom software is reviewed prior to being released to production", True),
    ("6.2.3", "Pre-production environments are separated from production environments", True),
    ("6.2.4", "Software engineering techniques are applied to prevent or mitigate common software attacks and vulnerabilities", True),
    ("6.3.1", "Security vulnerabilities are identified and addressed", True),
    ("6.3.2", "An inventory of bespoke and custom software is maintained", True),
    ("6.3.3", "All system components are protected from known vulnerabilities by installing applicable security patches", True),
    ("6.4.1", "Public-facing web applications are protected against attacks", True),
    ("6.4.2", "Payment page scripts are managed to ensure security of the transaction", True),
    ("6.5.1", "Change control processes are implemented", True),
    ("7.2.1", "An access control model is defined and implemented", True),
    ("7.2.2", "Access to system components and data is assigned based on individuals' job functions", True),
    ("7.2.4", "All user access is reviewed periodically", True),
    ("7.2.5", "All application and system accounts and related access privileges are assigned and managed", True),
    ("7.2.6", "All user account access to query repositories of stored cardholder data is restricted", True),
    ("7.3.1", "Access to system components and data is managed via an access control system(s)", True),
    ("8.2.1", "Strong authentication for users and administrators is established and managed", True),
    ("8.2.2", "Strong authentication for service providers with remote access is managed", True),
    ("8.3.1", "Multi-factor authentication (MFA) is implemented for all access into the CDE", True),
    ("8.3.2", "MFA is implemented for all access to the CDE", True),
    ("8.3.6", "Authentication mechanisms are independent of one another", True),
    ("8.3.9", "Access to application and system accounts is managed", True),
    ("8.4.2", "MFA is implemented for all access to system components", True),
    ("8.5.1", "MFA systems are configured to prevent misuse", True),
    ("8.6.1", "If passwords are used, complexity and strength requirements are implemented", True),
    ("8.6.2", "If passwords are used, minimum password length is established", True),
    ("8.6.3", "If passwords are used, password history is maintained", True),
    ("9.1.2", "Physical access controls are in place to restrict access to cardholder data", False),
    ("10.2.1", "Audit logs capture all individual user access to cardholder data", True),
    ("10.2.1.1", "Audit log entries are generated for all access to cardholder data", True),
    ("10.2.1.2", "Audit log entries are generated for all actions by individuals with administrative access", True),
    ("10.2.1.3", "Audit log entries are generated for all access to audit logs", True),
    ("10.2.1.4", "Audit log entries are generated for all invalid logical access attempts", True),
    ("10.2.1.5", "Audit log entries are generated for all changes to identification and authentication credentials", True),
    ("10.2.1.6", "Audit log entries are generated for all initialization of audit logs", True),
    ("10.2.2", "Audit logs are implemented to support anomaly detection", True),
    ("10.3.1", "Audit log entries contain sufficient detail to reconstruct events", True),
    ("10.3.2", "User identity is captured in audit logs", True),
    ("10.4.1", "A log review is performed for all system components", True),
    ("10.4.2", "Logs for critical security control systems are reviewed frequently", True),
    ("11.3.1", "External vulnerability scans are performed", True),
    ("11.3.2", "Internal vulnerability scans are performed", True),
    ("11.4.1", "Penetration testing is performed", True),
    ("11.5.1", "Network intrusions and unexpected file changes are detected", True),
    ("11.6.1", "Unauthorized changes on payment pages are detected and responded to", True),
    ("12.3.1", "Personnel are trained in security awareness", False),
    ("12.6.1", "Security awareness training is provided to all personnel", False),
    ("12.6.3", "Personnel acknowledge they have read and understood the information security policy", False),
]


def sub_requirements() -> list[dict]:
    return [{"req_id": sub_id.split(".")[0], "sub_id": sub_id, "description": text, "relevant": relevant}
            for sub_id, text, relevant in SUB_REQUIREMENTS]


# Remediation text per sub-requirement.
ACTIONS = {
    "6.2.4": "Implement input validation, output encoding, and parameterized queries to prevent injection attacks",
    "8.2.1": "Remove hardcoded credentials and implement strong authentication mechanisms",
    "8.3.1": "Implement multi-factor authentication for all CDE access",
    "3.5.1": "Encrypt all stored cardholder data using strong cryptography",
    "4.2.1": "Ensure all cardholder data transmission uses TLS 1.2+ with strong cipher suites",
    "7.2.1": "Implement role-based access control (RBAC) with least privilege principle",
    "10.2.1": "Implement comprehensive audit logging for all access to cardholder data",
    "2.2.2": "Change all vendor default passwords and remove unnecessary default accounts",
    "3.3.1": "Remove logging of sensitive authentication data (CVV, PIN, full track data)",
    "6.4.1": "Deploy WAF or implement RASP for web application protection",
    "3.6.1": "Implement secure key management with proper encryption of cryptographic keys",
}

# STRIDE category to sub-requirement, confidence, reason.
BY_STRIDE = {
    "S": [("8.2.1", 0.85, "Spoofing threats relate to authentication weaknesses (Req 8.2.1)"),
          ("8.3.1", 0.75, "Spoofing can be mitigated with multi-factor authentication (Req 8.3.1)")],
    "T": [("6.2.4", 0.8, "Tampering threats indicate input validation vulnerabilities (Req 6.2.4)"),
          ("10.2.2", 0.7, "Tampering detection requires audit logging (Req 10.2.2)")],
    "R": [("10.2.1", 0.9, "Repudiation threats require comprehensive audit logs (Req 10.2.1)"),
          ("10.3.1", 0.85, "Audit logs must contain sufficient detail to reconstruct events (Req 10.3.1)")],
    "I": [("3.5.1", 0.9, "Information disclosure threatens stored cardholder data (Req 3.5.1)"),
          ("4.2.1", 0.85, "Data in transit must be encrypted (Req 4.2.1)"),
          ("7.2.1", 0.75, "Access controls prevent unauthorized data disclosure (Req 7.2.1)")],
    "D": [("6.2.4", 0.7, "DoS vulnerabilities should be prevented through secure coding (Req 6.2.4)"),
          ("11.3.1", 0.65, "Vulnerability scanning can detect DoS weaknesses (Req 11.3.1)")],
    "E": [("7.2.2", 0.9, "Privilege escalation violates least privilege principle (Req 7.2.2)"),
          ("8.2.1", 0.8, "Strong authentication prevents privilege escalation (Req 8.2.1)")],
    "L": [("7.2.1", 0.85, "Lateral movement indicates access control failures (Req 7.2.1)"),
          ("1.4.2", 0.75, "Network segmentation prevents lateral movement (Req 1.4.2)")],
    "M": [("6.2.4", 0.8, "Secure coding prevents malware injection (Req 6.2.4)"),
          ("6.4.1", 0.75, "Web application protection prevents malware delivery (Req 6.4.1)")],
}

# Weakness-id texts (matched as substrings) to sub-requirement, confidence, reason tail.
BY_CWE = [
    (["89", "79", "78", "90"], [
        ("6.2.4", 0.95, "Injection vulnerabilities must be prevented (Req 6.2.4)"),
        ("6.4.1", 0.85, "Web applications must be protected (Req 6.4.1)")]),
    (["798", "259", "321"], [
        ("8.2.1", 0.95, "Strong authentication required (Req 8.2.1)"),
        ("3.6.1", 0.85, "Cryptographic keys must be protected (Req 3.6.1)")]),
    (["327", "326", "328"], [
        ("4.2.1", 0.9, "Strong cryptography required for data in transit (Req 4.2.1)"),
        ("3.5.1", 0.9, "Strong cryptography required for stored data (Req 3.5.1)")]),
    (["284", "285", "862"], [
        ("7.2.1", 0.9, "Access control model required (Req 7.2.1)"),
        ("7.3.1", 0.85, "Access control systems required (Req 7.3.1)")]),
    (["200", "209", "532"], [
        ("3.3.1", 0.9, "Sensitive authentication data must not be retained (Req 3.3.1)"),
        ("10.3.1", 0.8, "Audit logs must not contain sensitive data (Req 10.3.1)")]),
    (["778", "223"], [
        ("10.2.1", 0.9, "Comprehensive audit logging required (Req 10.2.1)")]),
]

# Text phrases (matched as substrings) to sub-requirement, confidence, reason.
BY_KEYWORD = [
    (["sql injection", "sqli"], [
        ("6.2.4", 0.95, "SQL injection must be prevented through secure coding (Req 6.2.4)"),
        ("6.4.1", 0.85, "Web applications must be protected against SQL injection (Req 6.4.1)")]),
    (["cross-site scripting", "xss"], [
        ("6.2.4", 0.95, "XSS must be prevented through input validation and output encoding (Req 6.2.4)"),
        ("6.4.1", 0.9, "Web applications must be protected against XSS (Req 6.4.1)")]),
    (["hardcoded", "hard-coded", "embedded credential", "default password"], [
        ("8.2.1", 0.95, "Hardcoded credentials violate strong authentication requirements (Req 8.2.1)"),
        ("2.2.2", 0.9, "Default credentials must be changed (Req 2.2.2)"),
        ("3.6.1", 0.85, "Cryptographic keys must not be hardcoded (Req 3.6.1)")]),
    (["weak crypto", "weak encryption", "insecure algorithm", "md5", "sha1", "des"], [
        ("4.2.1", 0.95, "Strong cryptography required for data in transit (Req 4.2.1)"),
        ("3.5.1", 0.9, "Strong cryptography required for stored cardholder data (Req 3.5.1)")]),
    (["missing authentication", "no authentication", "unauthenticated"], [
        ("8.2.1", 0.95, "All access must be authenticated (Req 8.2.1)"),
        ("7.2.1", 0.85, "Access control model required (Req 7.2.1)")]),
    (["missing authorization", "no authorization", "unauthorized access"], [
        ("7.2.1", 0.95, "Authorization controls required (Req 7.2.1)"),
        ("7.3.1", 0.9, "Access control systems required (Req 7.3.1)")]),
    (["insufficient logging", "missing log", "no audit"], [
        ("10.2.1", 0.9, "Comprehensive audit logging required (Req 10.2.1)"),
        ("10.3.1", 0.85, "Audit logs must contain sufficient detail (Req 10.3.1)")]),
    (["sensitive data in log", "card number in log", "password in log"], [
        ("3.3.1", 0.95, "Sensitive authentication data must not be logged (Req 3.3.1)"),
        ("10.3.1", 0.9, "Audit logs must not contain sensitive authentication data (Req 10.3.1)")]),
    (["missing tls", "no encryption", "unencrypted", "plaintext"], [
        ("4.2.1", 0.95, "Strong cryptography required for transmission (Req 4.2.1)"),
        ("2.2.7", 0.85, "Non-console administrative access must be encrypted (Req 2.2.7)")]),
    (["weak password", "password complexity", "password policy"], [
        ("8.6.1", 0.9, "Password complexity requirements must be implemented (Req 8.6.1)"),
        ("8.6.2", 0.85, "Minimum password length must be established (Req 8.6.2)")]),
    (["missing mfa", "no multi-factor", "no 2fa"], [
        ("8.3.1", 0.95, "Multi-factor authentication required for CDE access (Req 8.3.1)"),
        ("8.4.2", 0.9, "MFA required for all system component access (Req 8.4.2)")]),
    (["pan", "card number", "cardholder data", "credit card"], [
        ("3.5.1", 0.95, "Primary account number must be secured (Req 3.5.1)"),
        ("3.2.1", 0.85, "Account data storage must be minimized (Req 3.2.1)")]),
]

# Scanner rule ids.  Each row: words of which one must occur, sub-requirement,
# confidence, reason head (the rule id follows).
BY_RULE_ID = [
    (["pci-cardholder"], "3.5.1", 0.95, "PCI-specific rule: "),
    (["pci-crypto"], "4.2.1", 0.95, "PCI-specific rule: "),
    (["pci-auth"], "8.2.1", 0.95, "PCI-specific rule: "),
    (["pci-logging"], "10.2.1", 0.95, "PCI-specific rule: "),
    (["sql-injection", "sqli"], "6.2.4", 0.9, "SQL injection detected by rule: "),
    (["hardcoded", "hard-coded"], "8.2.1", 0.9, "Hardcoded credential detected by rule: "),
]
