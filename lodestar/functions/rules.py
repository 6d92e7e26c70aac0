"""Roles of commanders and what they weigh."""

from __future__ import annotations

# Role weights.
ROLES = {"overall_commander": 1.00, "principal_field_commander": 0.85, "coalition_commander": 0.70, "naval_commander": 0.75, "siege_engineer_or_specialist": 0.70, "wing_or_corps_commander": 0.55, "staff_or_planning_role": 0.45, "subordinate_commander": 0.35, "nominal_or_political_leader": 0.20, "unclear_role": 0.40}
#: Roles of direct command in the field.
DIRECT = ["overall_commander", "principal_field_commander", "wing_or_corps_commander", "naval_commander"]
