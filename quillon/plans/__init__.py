from quillon.plans.revenue import revenue_by_nation

__all__ = ["revenue_by_nation"]
