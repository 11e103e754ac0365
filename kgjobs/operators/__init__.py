"""Set-at-a-time operators on rules, feedback, memories, edges and chunks."""
