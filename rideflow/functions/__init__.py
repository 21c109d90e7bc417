"""Column expressions: rounding, pricing, clock and label text, hexagon cells."""
