"""Text guardrails on Spark."""
