"""Fixed values of the SQL in :mod:`folioflow.plans.oracles`, kept apart so that a change of the code does not change them.

Most were taken over from the code's tables; the stop list, the page pattern and the headings were compared with their source.
"""

from __future__ import annotations

# Fixed values.
KEYWORDS = (
    "membrane", "ion", "flux", "diffusion", "current", "voltage", "potential", "concentration", "transport", "electro", "charge", "field", "gradient", "poisson", "nernst", "planck",
    "navier", "stokes", "диссоциац", "рекомбинац", "электродиализ", "мембран", "концентрац", "поток", "потенциал", "пуассона", "нернста", "планка", "навье", "стокса", "электроконвекц",
    "пространственный заряд", "область пространственного заряда", "диффузионный слой",
)
CHARACTERS = (
    ("\uf0b7", "-"), ("\ufeff", ""), ("\u200b", ""), ("\u00a0", " "), ("\uf020", " "), ("…", "..."), ("−", "-"), ("–", "-"), ("—", "-"), ("∙", "·"), ("⋅", "·"), ("§", ""), ("™", ""),
    ("®", ""),
)
LINK_STOP = (
    "для", "при", "это", "как", "или", "что", "где", "также", "который", "equation", "formula", "model", "where", "with", "from", "this", "формула", "уравнение", "модель", "глава", "стр",
    "страница",
)
MATH_TERMS = (
    "уравнение", "equation", "формула", "formula", "нернста", "nernst", "планка", "planck", "пуассона", "poisson", "навье", "navier", "стокса", "stokes", "коэффициент", "coefficient",
    "концентрация", "concentration", "поток", "flux", "потенциал", "potential", "плотность тока", "current density", "диссоциация", "dissociation", "рекомбинация", "recombination", "k_d",
    "kd", "k_r", "kr", "k_w", "kw", "константа", "constant", "вода", "water", "ph", "водородный", "гидроксил", "гидроксида", "ион", "ion", "электродиализ", "electrodialysis", "мембрана",
    "membrane", "опз", "область пространственного заряда", "space charge", "space-charge", "дебаев", "debye", "вах", "вольт-ампер", "current-voltage", "overlimiting current",
    "limiting current",
)
HEADINGS = (
    "Введение", "INTRODUCTION", "Аннотация", "ABSTRACT", "Реферат", "Ключевые слова", "KEYWORDS", "Заключение", "CONCLUSION", "ВЫВОДЫ", "Conclusions", "Литература", "Список литературы",
    "REFERENCES", "БИБЛИОГРАФИЧЕСКИЙ СПИСОК", "Результаты", "RESULTS", "Обсуждение", "DISCUSSION", "Методы", "METHODS", "Материалы и методы", "Теоретическая часть", "THEORETICAL",
    "Математическая модель", "MATHEMATICAL MODEL", "Постановка задачи", "Problem statement",
)
TOPICS = (
    "модель", "уравнения", "электроконвекция", "результаты", "концентрация", "потенциал", "диффузионный слой", "model", "equations", "electroconvection", "results", "diffusion layer",
    "mathematical",
)
CLASSES = (
    (("гранич", "boundary", "x=0", "x=h"), "boundary_conditions"), (("2d", "двумер", "электроконвек", r"\vec{v}"), "2D_electroconvection"),
    (("3d", "трехмер", "трёхмер", "x, y, z"), "3D_model"), (("стационар",), "1D_stationary"), (("нестационар", r"\partial"), "1D_unsteady"),
    (("pe", "re", "безразмер", "критер"), "dimensionless"),
)
PHENOMENA = (
    ("diffusion", ("диффуз", "diffusion", "d_i", "d_1", "d_2", r"\nabla c", r"\partial c")),
    ("migration", ("миграц", "migration", "электромиграц", "z_i", "electric field", r"\varphi", r"\vec{e}")),
    ("water_dissociation", ("диссоциац", "рекомбинац", "h_2o", "h^+", "oh^-", "k_d", "k_r", "k_w")), ("poisson_equation", ("пуассон", "poisson", r"\varepsilon", r"\rho", r"\sum")),
    ("space_charge", ("пространственный заряд", "опз", "space charge", r"\rho")), ("electroconvection", ("электроконвек", "electroconvection", r"\vec{v}", "navier", "stokes", "навье")),
    ("current_density", ("плотность тока", "current density", "i_c", r"\vec{i}", "i_{av}", "i_{lim}")), ("boundary_conditions", ("гранич", "boundary", "x=0", "x=h", "мембран")),
    ("dimensionless_parameters", ("pe", "re", "k_{el}", "безразмер", "критерий")), ("thermal_effects", ("температур", "тепло", "джоул", "q =", "t ")),
)
ALIASES = (
    (("нернст", "поток ионов"), ("уравнение Нернста-Планка", "поток ионов", "ионный поток"), ("Nernst-Planck equation", "ionic flux", "ion flux")),
    (("пуассон",), ("уравнение Пуассона", "электрический потенциал", "пространственный заряд"), ("Poisson equation", "electric potential", "space charge")),
    (("диссоциац", "рекомбинац"), ("диссоциация воды", "рекомбинация воды", "ионное произведение воды"), ("water dissociation", "water recombination", "water splitting")),
    (("навье", "стокс"), ("уравнение Навье-Стокса", "гидродинамика", "электроконвекция"), ("Navier-Stokes equation", "hydrodynamics", "electroconvection")),
    (("предельный",), ("предельный ток", "предельный диффузионный ток"), ("limiting current", "diffusion-limited current")),
    (("гранич",), ("граничные условия", "условия на мембране"), ("boundary conditions", "membrane boundary")),
)
GARBAGE = (
    r"\(cid:\d+\)", "�", "[©®™]", "https?://", r"www\.", "[‡†]", "[¦§]",
)
NOT_VARIABLES = (
    "frac", "partial", "nabla", "Delta", "sum", "int", "left", "right", "cdot", "times", "text", "mathrm", "operatorname", "quad", "qquad", "begin", "end", "equation", "align", "to",
    "leftrightarrow", "rightarrow", "leftarrow", "approx", "le", "ge", "ne", "varphi", "varepsilon",
)
TERM_STOP = (
    "для", "при", "как", "или", "что", "это", "the", "and", "with", "formula", "equation", "уравнение", "формула",
)
REPAIRS = (
    (r"O\s+H\s+d\s+C\s+k\s+v\s+2\s+1.*OH\s+H\s+r\s+C\s+C\s+k", r"v_1 = k_d C_{H_2O}, \quad v_2 = k_r C_{H^+} C_{OH^-}", 0.9),
    (r"k\s*d.*C.*H.*2.*O.*k\s*r.*C.*H.*C.*OH", "k_d C_{H_2O} = k_r C_{H^+} C_{OH^-}", 0.85), ("lg.*H.*C.*pH|pH.*lg.*H", r"\mathrm{pH} = -\lg C_{H^+}", 0.85),
)
SYMBOLS = r"\b(C_i|C_1|C_2|C_3|C_4|j_i|J_i|D_i|z_i|k_d|k_r|k_w|pH|Pe|Re|F|R|T|H|L|V_0|I_c|I|E|Na|Cl|OH|H_2O|H\+|OH\-)\b"
MATH = r"(=|\\frac|\\partial|\\nabla|\\Delta|\\sum|\\int|\^|_|[+\-*/]|≤|≥|≠|∂|∇|∆|Δ|∑|∫|√|∞|≈)"
ACRONYMS = "^(NaCl|KCl|CEM|AEM|EDL|SCR|DL|PD|PS)$"
SOURCE_TRUST = {'grobid': 0.45, 'mathml': 0.4, 'latex': 0.5, 'heuristic': 0.25, 'ocr': 0.1, 'pymupdf': 0.2}
