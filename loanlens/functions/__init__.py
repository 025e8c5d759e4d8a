"""Column expressions and joins the operators are written with."""
