"""Join plans: compositions of operators that produce pair tables."""
