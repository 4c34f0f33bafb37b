"""The published paired deltas of the 74 patients (late, k = 10, Spearman)."""

DELTAS = [
    0.024234675469247124,
    0.03460588903084272,
    0.02092262089032687,
    0.013855997358808714,
    0.02452722513589839,
    0.03036498675707583,
    0.055564805688579355,
    0.028415005456164988,
    0.019030485738950942,
    0.03688257444928572,
    0.0350355652972556,
    0.06383031536914768,
    0.10284209435443747,
    0.04803218662915476,
    0.017660394284768288,
    0.04097237607211762,
    0.027448487323153026,
    0.02891291786816408,
    0.0027717861021628876,
    0.0195235950122844,
    0.0012258163772407848,
    0.01602713175497683,
    0.07524153623653718,
    0.02573884475696242,
    0.0398951346823761,
    0.07068184582824394,
    0.0654797877365455,
    0.07008456717587677,
    0.0710287603778402,
    0.03538182344160523,
    0.028241783141563004,
    0.025116225760329625,
    0.0187084683443412,
    0.0434772699838607,
    0.0315539276940901,
    -0.0016185751598767895,
    0.0748593923837418,
    0.04155742503341636,
    0.04076292326730169,
    0.05839516186877988,
    0.02315327643957288,
    0.010784118395248676,
    0.025315363096168414,
    0.041467324427959196,
    -0.01833492278955509,
    0.02938589216295459,
    0.05963814507294529,
    0.010219572234739516,
    0.08029681099829572,
    0.0174104911250636,
    0.010486036912729813,
    0.09818396262725929,
    0.0248289313093788,
    0.02378072224138761,
    0.0399728435478712,
    0.10142886948929222,
    0.026737099470412196,
    0.0185138859283622,
    0.014156852265318431,
    0.0873524896526956,
    0.005273167804308393,
    -0.007683445239601794,
    0.04810769830885028,
    0.042038187733231695,
    0.03115196208056553,
    0.03877693700215712,
    0.0025402902570736408,
    0.04277765247896381,
    0.030100553478034003,
    0.0725513394900773,
    0.017918026807312804,
    0.018664162521834338,
    0.08688974216793481,
    0.1011311371392741,
]
