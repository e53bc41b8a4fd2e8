"""The jobs: roll-ups and integrity checks, reports, visibility, department
productivity and browser re-attribution steps."""
