"""granary: rollout analytics and corpus preparation expressed as Spark plans."""
