"""MAESTRO catalogue of agentic-system layers."""

# Layer codes in catalogue order (the order also breaks score ties).
CODES = ["1-Foundation", "2-DataKnowledge", "3-Frameworks", "4-Tooling", "5-Communication",
         "6-Deployment", "7-Ecosystem"]

# Full names.
FULL_NAMES = {
    "1-Foundation": "Foundation Models Layer",
    "2-DataKnowledge": "Data & Knowledge Layer",
    "3-Frameworks": "Agent Frameworks Layer",
    "4-Tooling": "Tooling & Integration Layer",
    "5-Communication": "Agent-to-Agent Communication Layer",
    "6-Deployment": "Deployment & Infrastructure Layer",
    "7-Ecosystem": "Ecosystem & Governance Layer",
}

# Named threats per layer.
THREATS = {
    "1-Foundation": [
        "Prompt Injection", "Jailbreaking", "Training Data Poisoning", "Model Theft/Extraction",
        "Adversarial Examples", "Model Inversion Attacks", "Membership Inference", "Backdoor Attacks",
        "Fine-tuning Poisoning", "Prompt Leaking"],
    "2-DataKnowledge": [
        "RAG Poisoning", "Vector Database Manipulation", "Knowledge Base Injection", "Embedding Attacks",
        "Context Window Stuffing", "Retrieval Manipulation", "Data Source Spoofing",
        "Semantic Search Exploits", "Index Poisoning", "Citation Manipulation"],
    "3-Frameworks": [
        "Insecure Tool/Function Calling", "Agent Memory Manipulation", "Chain Injection Attacks",
        "Workflow Hijacking", "Agent State Corruption", "Framework Vulnerabilities",
        "Dependency Confusion", "Agent Logic Bypass", "ReAct Loop Exploits",
        "Multi-Agent Coordination Attacks"],
    "4-Tooling": [
        "MCP Server Exploitation", "Tool/Plugin Poisoning", "API Key Theft",
        "Credential Leakage via Tools", "Unauthorized Tool Access", "Tool Input Injection",
        "API Abuse/Overuse", "Third-Party Integration Risks", "OAuth/Auth Token Theft",
        "Tool Privilege Escalation"],
    "5-Communication": [
        "Inter-Agent Message Spoofing", "Trust Boundary Violations", "Agent Impersonation",
        "Message Injection Attacks", "Protocol Manipulation", "Cascading Agent Failures",
        "Byzantine Agent Behavior", "Consensus Attacks", "Agent-to-Agent MITM",
        "Delegation Chain Exploits"],
    "6-Deployment": [
        "Container/VM Escape", "Resource Exhaustion (DoS)", "Sandbox Bypass", "Supply Chain Attacks",
        "Dependency Vulnerabilities", "Model Hosting Exploits", "Infrastructure Misconfigurations",
        "Secrets in Deployment Artifacts", "CI/CD Pipeline Compromise", "Model Serving Attacks"],
    "7-Ecosystem": [
        "Compliance Violations (GDPR, CCPA, AI Act)", "Audit Trail Manipulation", "Accountability Gaps",
        "Bias and Fairness Issues", "Explainability Failures", "Data Sovereignty Violations",
        "Regulatory Non-Compliance", "Ethical AI Breaches", "Transparency Failures",
        "Human Oversight Bypass"],
}

# Keywords, matched as whole words without case.
KEYWORDS = {
    "1-Foundation": [
        "prompt injection", "jailbreak", "adversarial", "model theft", "training data", "poisoning",
        "fine-tuning", "llm", "gpt", "claude", "gemini", "model extraction", "membership inference",
        "prompt leak", "system prompt", "model inversion", "backdoor", "dpo", "rlhf", "alignment",
        "safety"],
    "2-DataKnowledge": [
        "rag", "retrieval augmented generation", "vector database", "embedding", "knowledge base",
        "chromadb", "pinecone", "weaviate", "faiss", "milvus", "semantic search", "context window",
        "document injection", "citation", "knowledge graph", "index", "retrieval", "augmentation",
        "grounding"],
    "3-Frameworks": [
        "langchain", "autogen", "crewai", "agent", "framework", "tool calling", "function calling",
        "react", "reasoning", "action", "chain", "workflow", "orchestration", "memory", "state", "plan",
        "execute", "multi-agent", "crew", "llama-index", "haystack", "semantic kernel"],
    "4-Tooling": [
        "mcp", "model context protocol", "tool", "plugin", "api", "integration", "credential", "token",
        "oauth", "api key", "secret", "vault", "third-party", "external", "service", "webhook",
        "callback", "function", "execution", "invoke", "anthropic mcp", "openai plugin", "gpt action"],
    "5-Communication": [
        "multi-agent", "inter-agent", "agent communication", "message", "trust", "delegation", "handoff",
        "coordination", "consensus", "orchestration", "swarm", "collaboration", "protocol",
        "message passing", "peer-to-peer", "distributed", "federation", "agent network", "cascade",
        "failure propagation"],
    "6-Deployment": [
        "docker", "kubernetes", "container", "deployment", "infrastructure", "cloud", "aws", "azure",
        "gcp", "sandbox", "isolation", "resource", "cpu", "memory", "gpu", "quota", "limit",
        "supply chain", "dependency", "cicd", "pipeline", "artifact", "vllm", "triton", "model serving",
        "inference", "runtime"],
    "7-Ecosystem": [
        "compliance", "gdpr", "ccpa", "ai act", "regulation", "audit", "governance", "accountability",
        "bias", "fairness", "ethics", "explainability", "transparency", "human oversight", "hitl",
        "model card", "documentation", "data sovereignty", "privacy", "responsible ai",
        "trustworthy ai", "ai safety"],
}

# Weakness ids per layer.
CWE_IDS = {
    "1-Foundation": [77, 78, 94, 116, 159, 200, 502, 913],
    "2-DataKnowledge": [20, 74, 89, 94, 159, 471, 502, 601],
    "3-Frameworks": [20, 74, 94, 95, 116, 610, 732, 913],
    "4-Tooling": [200, 259, 285, 287, 306, 312, 319, 522, 798, 863],
    "5-Communication": [283, 287, 290, 345, 346, 384, 494, 923],
    "6-Deployment": [250, 400, 404, 502, 665, 770, 829, 915],
    "7-Ecosystem": [117, 532, 778, 779],
}

# Per layer, the score of one technology and the words that mark it.
TECHNOLOGY_WORDS = {
    "1-Foundation": (0.5, ["gpt", "claude", "llama", "gemini", "anthropic", "openai"]),
    "2-DataKnowledge": (0.5, ["rag", "vector", "chroma", "pinecone", "weaviate", "embedding"]),
    "3-Frameworks": (0.5, ["langchain", "autogen", "crewai", "haystack", "semantic kernel"]),
    "4-Tooling": (0.3, ["mcp", "plugin", "api", "integration"]),
    "6-Deployment": (0.3, ["docker", "kubernetes", "aws", "azure", "gcp", "cloud"]),
}

# What an architecture flag adds to a layer.
ARCHITECTURE_FLAGS = {
    "has_agents": {"1-Foundation": 0.4, "3-Frameworks": 0.6},
    "has_rag": {"2-DataKnowledge": 0.8, "1-Foundation": 0.3},
    "has_tool_calling": {"4-Tooling": 0.7, "3-Frameworks": 0.4},
    "has_multi_agent": {"5-Communication": 0.9, "3-Frameworks": 0.5},
}

# What a deployment model adds to a layer.
DEPLOYMENT_MODELS = {
    "cloud": {"6-Deployment": 0.6, "7-Ecosystem": 0.3},
    "saas": {"6-Deployment": 0.6, "7-Ecosystem": 0.3},
    "on-prem": {"6-Deployment": 0.5},
    "self-hosted": {"6-Deployment": 0.5},
    "hybrid": {"6-Deployment": 0.7, "5-Communication": 0.3},
}

# Context flag, layer and score.
CONTEXT_FLAGS = {
    "uses_llm": ("1-Foundation", 0.6),
    "has_data_pipeline": ("2-DataKnowledge", 0.5),
    "has_external_integrations": ("4-Tooling", 0.6),
    "compliance_required": ("7-Ecosystem", 0.7),
}

# Layer to ATT&CK technique, weight and reason, in listing order.
TECHNIQUES = {
    "1-Foundation": [("T1190", 0.8, "Exploiting LLM APIs and interfaces"),
                     ("T1059", 0.7, "Prompt injection leading to code execution"),
                     ("T1005", 0.6, "Training data extraction")],
    "2-DataKnowledge": [("T1565", 0.9, "RAG poisoning and knowledge base manipulation"),
                        ("T1083", 0.6, "Discovering knowledge sources"),
                        ("T1005", 0.7, "Accessing vector databases")],
    "3-Frameworks": [("T1059", 0.9, "Exploiting agent tool calling for code execution"),
                     ("T1203", 0.7, "Framework vulnerabilities"),
                     ("T1068", 0.6, "Agent privilege escalation")],
    "4-Tooling": [("T1555", 0.9, "Stealing API keys and credentials from tools"),
                  ("T1078", 0.8, "Using stolen credentials"),
                  ("T1021", 0.7, "Abusing tool integrations for access")],
    "5-Communication": [("T1021", 0.8, "Agent-to-agent communication exploitation"),
                        ("T1550", 0.7, "Agent impersonation"),
                        ("T1071", 0.6, "Inter-agent protocol manipulation")],
    "6-Deployment": [("T1068", 0.9, "Container escape and sandbox bypass"),
                     ("T1499", 0.8, "Resource exhaustion"),
                     ("T1543", 0.7, "Persistence in deployment environment")],
    "7-Ecosystem": [("T1070", 0.8, "Audit trail manipulation"),
                    ("T1562", 0.7, "Bypassing compliance controls"),
                    ("T1565", 0.6, "Manipulating audit logs")],
}
