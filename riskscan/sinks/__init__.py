"""Writers and the projections that shape findings for them."""
