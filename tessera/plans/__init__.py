"""From SQL text to a bound statement."""
