"""Skill-graph data jobs on Spark."""
